"""Mixing, decontamination, extraction, token files, archives and the pipeline."""

import gzip
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakegauge.llm import decontaminate, extraction, mixing, simhash, tokens, warc
from lakegauge.llm.common import new_path, read, shared_folder
from lakegauge.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def plain_targets(sizes):
    """Shares by weight; what is above three times a size stops there, and the excess is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = total - sum(stopped.values())
        open_weight = sum(w for s, w in weight.items() if s not in stopped)
        share = {s: rest * weight[s] / open_weight for s in names if s not in stopped}
        above = {s: 3 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not above:
            return stopped | share
        stopped |= above


def test_mixture(spark):
    rnd = random.Random(0)
    rows = []
    for source, n in (("big", 300), ("a", 5), ("b", 60), ("é", 40), (None, 30), ("Z", 3), ("zero", 2)):
        for _ in range(n):
            rows.append((len(rows), " ".join(["w"] * (0 if source == "zero" else rnd.randint(1, 60))), source, "m", 1))
    rows += [(None, "x y", "a", "m", 2), (3, None, "big", "m", 3), (3, "", "big", "m", 4), (4, rows[4][1], "big", "m", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix string, _mix_source int")
    plan = mixing.planned(docs)
    name = mixing.mix_column(docs)
    assert plan.columns == [*docs.columns, name]
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    got, taken = plan.select("source", "doc_id", F.col(name).alias("m")).collect(), {}
    assert len(got) == len(rows)
    for r in got:
        assert r.m.source_size == sizes[r.source] and r.m.target == pytest.approx(want[r.source])
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(rate) <= r.m.copies <= min(3, int(rate) + 1)
        taken[r.source] = taken.get(r.source, 0) + r.m.size * r.m.copies
    assert all(abs(taken[s] - want[s]) <= 0.25 * want[s] + 60 for s in sizes)
    assert sorted(map(str, plan.collect())) == sorted(map(str, mixing.planned(docs.repartition(7)).collect()))
    emitted = mixing.mixed(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.m.copies for r in got)
    assert mixing.planned(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def plain_contamination(texts, items, width=13):
    words = [decontaminate.words_of(t.encode() if t else None) for t in texts]
    phrases = {}
    for key, text in items:
        w = decontaminate.words_of(text.encode() if text else None)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + width]), set()).add(str(key))
    out = []
    for w in words:
        hit, own = set(), set()
        for phrase, keys in phrases.items():
            for i in range(len(w) - len(phrase) + 1):
                if tuple(w[i : i + len(phrase)]) == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    own |= keys
        out.append((len(w), len(hit), sorted(own)))
    return out


@pytest.mark.parametrize(("shard", "block"), [(decontaminate.SHARD_BYTES, decontaminate.BLOCK), (150, 7)])
def test_decontamination(spark, shard, block):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["the", "of", "and", "Über", "x1", "rare", "blue", "ño"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 13, 14, 5, 1, 40, 0])] + [(50, None), (3, "of of OF of")]
    texts = [None, "", "...", "the, of"]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 2)):
            parts += [rnd.choice(items)[1] or "", word()]
        texts.append(rnd.choice([" ", "\n", "-"]).join(parts))
    docs = spark.createDataFrame([(i // 2, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard int, items string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.contamination(docs, benchmark, block=block)
    assert index.count() == len(texts)
    built = decontaminate.build_index(docs, shard_bytes=shard)
    assert sum(len(r["ids"]) for r in built.collect()) == len(texts)
    got = sorted((r["id"], r.n_words, r.n_hit, list(r["items"])) for r in index.collect())
    want = sorted((i // 2, *w) for i, w in enumerate(plain_contamination(texts, items)))
    assert got == want
    for r in index.collect():
        assert sum(s.stop - s.start for s in r.spans) == r.n_hit and all(0 <= s.start < s.stop <= r.n_words for s in r.spans)
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    items = [(i, " ".join(rnd.choice("abcdefghz") for _ in range(4))) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    every = " ".join(texts).split()
    want = {}
    for i, text in enumerate(texts):
        words, found = text.split(), set()
        for key, phrase in items:
            own = phrase.split()
            rare = min(range(4), key=lambda k: (every.count(own[k]), k))
            for p in (p for p, w in enumerate(words) if w == own[rare]):
                if all(w in words[max(0, p - 3) : p + 4] for w in own):
                    found.add(str(key))
        want[i] = sorted(found)
    for block in (decontaminate.BLOCK, 3):
        got = decontaminate.contamination(docs, benchmark, reach=3, block=block)
        assert {r["id"]: list(r.near_items) for r in got.collect()} == want


def test_clean_documents_keep_all_columns(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, passage, 5), (2, "clean words", 6), (3, passage + " w" * 500, 7), (None, None, 8), (2, passage, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    left = decontaminate.clean_documents(docs, benchmark)
    assert left.columns == docs.columns and sorted(r["id"] for r in left.collect()) == [6, 7, 8]


def test_clean_documents_leave_no_index_on_disk(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "d e")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before, verdicts = set(folder.glob("postings-*")), len(list(folder.glob("bad-*")))
    left = decontaminate.clean_documents(docs, benchmark)
    assert set(folder.glob("postings-*")) == before and len(list(folder.glob("bad-*"))) == verdicts + 1
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href=x>Home</a><li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><article><h1>Big &amp; bold&nbsp;title</h1><p>One <b>two</b>
 three<br>four<p>Second <a href='?a>b'>link</a> &lt;tag&gt; &eacute;<div class="ad">Buy now</div><form>Your mail<input></form>
<!-- hidden <p>no</p> --><p hidden>unseen</p><ul><li>first<li>second</ul><section id="comments"><p>Nice post!</p></section></article>
<footer>&copy; Site</footer></body></html>"""


def test_article_of_a_page():
    text, _, _ = (x[0] for x in extraction.main_texts([PAGE]))
    assert text == "Big & bold title\nOne two three four\nSecond link <tag> é\nfirst\nsecond"


def test_articles_are_not_lost_by_their_names():
    """Names that only mention a menu or notice keep the article; whole names of such, at any length, go."""
    kept = [
        '<main class="content with-sidebar"><p>kept text</p></main>', '<article class="post has-comments"><p>kept text</p></article>',
        '<article id="ad-blocking-explained">kept text</article>', '<div id="page-no-sidebar"><article>kept text</article></div>',
        '<article><p class="notice-board">kept text</p></article>', '<div class="widget"><nav>Home</nav><article>kept text</article></div>',
        '<article>kept text<div class="site-footer">f</div><ul class="related-posts x"><li>r</ul><i class="ad_slot-2">a</i></article>',
        '<article>kept <span class="ad">Buy now</span><b hidden>x</b>text</article>',
        '<article>kept text</article><section id="comments"><article class="comment">Nice post!</article></section>',
    ]
    for page in kept:
        assert extraction.main_texts([f"<html><body class='menu'>{page}<footer>end</footer></body></html>"])[0] == ["kept text"], page
    assert extraction.main_texts(['<div id="comments"><article class="comment">Nice post!</article></div>'])[0] == [""]
    assert [extraction.is_sign(n) for n in ("nav", "Nav-1".lower(), "box", "", "no-ads")] == [True, True, False, False, False]


def test_pages_without_article_keep_unique_runs(spark):
    menu = "Welcome to the site of all good things that we sell every day of the year"
    pages = [f"<body><div>{menu}</div><p>Story {i} tells of w{i} and v{i} u{i} once</p></body>" for i in range(4)]
    rows = [(i, f"http://h.example/{i}", p, "x") for i, p in enumerate(pages)]
    rows += [(10, "http://h.example/n", None, "x"), (None, None, "<p>alone &#8212; here", "x"), (12, "not a url", "", "x"), (13, "http://o.example", "<b>open <i>end", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in extraction.extract(table).collect()}
    assert got == {i: f"Story {i} tells of w{i} and v{i} u{i} once" for i in range(4)} | {10: "", None: "alone — here", 12: "", 13: "open end"}
    assert extraction.extract(table.limit(0)).count() == 0


def test_repeats_as_in_brute_force():
    rnd = np.random.RandomState(2)
    lengths = rnd.randint(0, 60, 12)
    pages = np.repeat(np.arange(12), lengths)
    toks = rnd.randint(0, 3, lengths.sum())
    block = rnd.randint(0, 3, 11)
    for at in (5, 90, 200):
        toks[at : at + 11] = block
    want = np.zeros(len(toks), bool)
    runs = {}
    for i in range(len(toks) - 7):
        if pages[i] == pages[i + 7]:
            runs.setdefault(tuple(toks[i : i + 8]), []).append(i)
    for at in runs.values():
        if len({pages[i] for i in at}) > 1:
            for i in at:
                want[i : i + 8] = True
    assert np.array_equal(extraction.repeated(toks, pages), want)


def test_given_pages_give_their_articles(spark):
    import html
    import re

    for r in QUERIES["op5_html_extraction"](spark, SF).join(read(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.sub(r"<(?!/?(?:h1|p)\b)[^>]*>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        parts = (" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:h1|p)>", inner))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_wavelet_matrix():
    rnd = np.random.RandomState(3)
    for n, top in ((0, 5), (1, 1), (700, 3), (3000, 50_000)):
        ids = rnd.randint(0, top, n).astype(np.uint32)
        data = tokens.pack(ids, np.array([n]), 16)
        matrix, ends = tokens.unpack(data)
        assert ends.tolist() == [n] and np.array_equal(matrix.decode(), ids)
        for i in rnd.randint(0, n, 20) if n else []:
            value = int(ids[i])
            assert matrix.access(int(i)) == value
            where = np.flatnonzero(ids == value)
            assert matrix.count(value) == len(where) and matrix.locate(value, len(where) - 1) == where[-1]
            assert matrix.count(value, 10, 500) == (ids[10:500] == value).sum()
    with pytest.raises(ValueError, match="cut short"):
        tokens.unpack(tokens.pack(np.arange(9), np.array([9]), 16)[:-1])


ODD = [None, "", " ", " a", "a  b", "a <|endoftext|> b", "it's we'll x'y", "end ", "\n", "a\nb c\n\nd", "a. b, c.. ., 3. é. 12,5.", "a \x1c b", "x y  z", "日本 語 ​q", "A"]


@pytest.mark.parametrize("kept", [1_000_000, 3])
def test_ids_are_those_of_the_library(monkeypatch, kept):
    monkeypatch.setattr(tokens, "KEPT_WORDS", kept)
    coder = tokens.Encoder(tokenizer_path())
    for _ in range(2):
        ids, sizes = coder.encode(pa.array(ODD, pa.string()))
        want = [e.ids for e in coder.tokenizer.encode_batch([t or "" for t in ODD], add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_files(spark):
    rows = [(i * 7 % 23 - 5, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (3, "same id", "x"), (3, "same id again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(5)
    found = tokens.token_files(docs, tokenizer_path(), shard_ids=16).orderBy("start").collect()
    assert len(found) == len(rows)
    keys = [(r["id"] is not None, r["id"]) for r in found]
    assert keys == sorted(keys, key=lambda k: (k[0], k[1] or 0))
    coder, start = tokens.Encoder(tokenizer_path()), 0
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append([*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    for r in found:
        assert r.start == start and list(r.ids) in texts[r["id"]]
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert tokens.token_files(docs.limit(0), tokenizer_path()).count() == 0


def test_archives(spark):
    big = "".join(f"<p>{i} é" for i in range(9000))
    rows = [(1, "http://a/1", "x"), (2, "http://a/2 b\n", big), (3, None, "x"), (4, "u", None), (5, "u", ""), (6, "u", big), (6, "u", big), (None, "u", "x"), (7, "u", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = new_path(spark, "archive")
    warc.write_warc(pages, path, segment=1000)
    records = warc.read_warc(spark, path)
    page = lambda name: name and ":".join(name.split(":")[:3]) + ">"
    stored = {(page(r.origin), bytes(r.payload).decode()) for r in records.where("record_type = 'response'").collect()}
    assert stored == {("<urn:page:1>", "x"), ("<urn:page:2>", big), ("<urn:page:4>", ""), ("<urn:page:7>", rows[-1][2])}
    facts = sorted((page(r.origin), r.record_type, page(r.refers_to), r.payload_bytes, r.payload_digest) for r in warc.record_facts(records).collect() if r.record_type == "revisit")
    n, digest = len(big.encode()), warc.base32_sha1(big.encode())
    one = ("<urn:page:1>", 1, warc.base32_sha1(b"x"))
    assert facts == sorted(
        [("<urn:page:3>", "revisit", *one), ("<urn:page:null>", "revisit", *one), ("<urn:page:5>", "revisit", "<urn:page:4>", 0, warc.base32_sha1(b""))]
        + [("<urn:page:6>", "revisit", "<urn:page:2>", n, digest)] * 2
    )
    assert warc.archived(pages.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 40_000])
def test_repeated_rows_and_ids_keep_their_records(spark, size):
    """Equal rows, rows of one id and different payloads, and null ids are a record each, at any size."""
    a, b, c = ("".join(random.Random(k).choice("abc ") for _ in range(size)) for k in range(3))
    rows = [(1, a), (1, a), (1, b), (2, b), (2, a), (None, c), (None, c), (None, b), (3, None), (3, "")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    facts = warc.record_facts(warc.archived(pages))
    got = sorted((r.origin.split(":")[2], r.record_type, (r.refers_to or "").split(":")[2:3], r.payload_bytes, r.payload_digest) for r in facts.collect())
    least, want = {a: 1, b: 1, c: None, "": 3}, []
    for i, h in rows:
        h = h or ""
        again = least[h] is not None and i != least[h]
        want.append((str(i or "null"), "revisit" if again else "response", [str(least[h])] if again else [], len(h), warc.base32_sha1(h.encode())))
    assert got == sorted(want)


def test_archives_roll_to_new_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    pages = spark.range(200).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 300) as html").coalesce(1)
    path = new_path(spark, "archive")
    warc.write_warc(pages, path, segment=1000)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    assert len(files) > 3 and max(len(gzip.decompress(bytes(f.content))) for f in files) < 50_000
    assert warc.record_facts(warc.read_warc(spark, path)).count() == 200


def test_broken_archives(spark):
    payload = b"abc" * 2000
    records = list(warc.response_records("1", "u", payload, warc.base32_sha1(payload), 700))
    archive = b"".join(r + b"\r\n" for r in records)
    assert [f["warc-type"] for f, _ in warc.parse(archive)] == ["response"] + ["continuation"] * (len(records) - 1)
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(archive[:-3]))
    with pytest.raises(ValueError, match="chunk is cut short"):
        warc.unchunked(b"5\r\nabcd\r\n0\r\n\r\n")
    assert warc.unchunked(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: z\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError, match="payload digest"):
        warc._verified(b"HTTP/1.1 200 OK\r\n\r\nabc", "WRONG")
    for broken in (records[:2] + records[3:], records[:-1] + [records[-1].replace(b"Total-Length: ", b"Total-Length: 9")]):
        name = new_path(spark, "broken")
        lines = spark.createDataFrame([(r.decode(),) for r in broken], "value string").coalesce(1)
        lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(name)
        with pytest.raises(Exception, match="segments"):
            warc.read_warc(spark, name).collect()
    assert gzip.decompress(gzip.compress(archive)) == archive


def test_pipeline_stages_as_in_brute_force(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    known = corpus_pipeline.keep_known_languages(spark, docs, SF)
    want = [r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert known.columns == columns and sorted(r.doc_id for r in known.collect()) == sorted(want)
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    rows = docs.collect()
    found = plain_contamination([r.text for r in rows], items)
    assert clean.columns == columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r, (n, hit, _) in zip(rows, found) if not (hit and 20 * hit >= n))
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    copies = {r.doc_id: r.mix.copies for r in mixing.planned(docs).collect()}
    assert mixed.columns == columns and mixed.count() == sum(copies.values())


def test_near_copies_as_in_brute_force(spark):
    rows = read(spark, SF, "documents").collect()
    sets = {}
    for r in rows:
        sets[r.doc_id] = set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist())
    docs = read(spark, SF, "documents")
    groups = {}
    for r in simhash.near_copies(docs).collect():
        groups[r["id"]] = r.component
    jaccard = lambda a, b: len(a & b) / max(len(a | b), 1) if a or b else 1.0
    ids = sorted(sets)
    close = [(i, j) for k, i in enumerate(ids) for j in ids[:k] if jaccard(sets[i], sets[j]) >= 0.8]
    assert close and not [p for p in close if groups[p[0]] != groups[p[1]]]
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert len(left) == len(set(groups.values()))
    for gone in set(ids) - left:  # nothing goes without a document like it
        assert max(jaccard(sets[gone], sets[o]) for o in ids if o != gone) >= 0.8


def test_pipeline_runs_to_token_files(spark):
    found = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert found and found[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:]))


def test_stages_of_no_documents_null_ids_and_clashing_names(spark, tmp_path):
    docs = read(spark, SF, "documents")
    odd = docs.limit(30).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))).withColumn("node", F.lit("n")).withColumn("_found", F.lit(1)).withColumn("mix", F.lit(2)).withColumn("_row_hash", F.lit(3)).withColumn("size", F.lit(4))
    for table in (docs.limit(0), odd):
        columns, count = table.columns, table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SF)
            assert table.columns == columns, name
        found = corpus_pipeline.STAGES[-1][1](spark, table, SF)
        assert (found.count() == 0) == (count == 0)


def test_repeats_do_not_depend_on_the_size_of_a_host(spark):
    """A notice on two of 600 pages without an article goes; copies of a page keep their text."""
    notice = "this notice stands on two pages of the whole host only"
    rows = [(i, f"<p>{' '.join(f'w{i}x{k}' for k in range(12))}</p>") for i in range(600)]
    for i in (0, 1, 300, 599):
        rows[i] = (i, rows[i][1] + f"<p>{notice} {'a' if i < 2 else 'b'}</p>")
    rows += [(600, rows[5][1]), (601, rows[5][1]), (602, None), (603, f"<article><p>{notice} c</p></article>")]
    table = spark.createDataFrame([(i, "http://h.example/x", h) for i, h in rows], "page_id long, url string, html string")
    texts, tokens, shared = extraction.main_texts([h for _, h in rows])
    want = {i: (t, n, m) for (i, _), t, n, m in zip(rows, texts, tokens, shared)}
    assert not any("notice" in want[i][0] for i in range(602)) and want[600][0] == want[5][0] != ""
    assert {r.page_id: (r.text, r.n_tokens, r.n_repeated) for r in extraction.extract(table).collect()} == want
    assert {r.page_id: r.text for r in extraction.extract(table, counts=False).collect()} == {i: w[0] for i, w in want.items()}


def test_pages_are_parsed_once_and_counted_in_small_parts(spark, tmp_path, monkeypatch):
    """The search of repeats takes tokens from what the one parse wrote; a slice's rows are a part of all runs."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(40)) + " this notice of nine words stands on each page"
    rows = [(i, "http://h.example/x", f"<article><h1>Title {i}</h1><p>{text(i)}</p></article><p>é\u2028ü &#8195; b{i}</p>") for i in range(50)]
    rows += [(50, "http://h.example/x", rows[0][2]), (51, None, None), (None, "http://o.example/x", rows[1][2])]
    log, parse = str(tmp_path / "parsed"), extraction.blocks

    def logged(page):
        with open(log, "a") as out:
            out.write("x")
        return parse(page)

    hosts: dict = {}
    for i, url, page in rows:
        hosts.setdefault(url, []).append((i, page))
    want = {}
    for own in hosts.values():
        want |= {i: found for (i, _), found in zip(own, zip(*extraction.main_texts([p for _, p in own])))}
    monkeypatch.setattr(extraction, "blocks", logged)
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_tokens, r.n_repeated) for r in extraction.extract(table).collect()}
    assert got == want and len({got[i][2] for i in range(50)}) == 1 and got[0][2] == 11
    with open(log) as parsed:
        assert len(parsed.read()) == len(rows)
    assert extraction.SLICES >= 4 and extraction.PARTS >= 4


def test_hashes_of_runs_tell_runs_and_hosts_apart():
    pages = ["a b c d e f g h i\nj é", "", "b c d e f g h\ni", "a b", "b a c d e f g h"]
    page, place, h = extraction.run_hashes([p.encode() for p in pages], ["x", "x", "x", "x", "x"])
    assert list(zip(page.tolist(), place.tolist())) == [(0, 0), (0, 1), (0, 2), (0, 3), (2, 0), (4, 0)]
    assert h[1] == h[4] and len(set(h.tolist())) == 5
    assert extraction.run_hashes([pages[2].encode()], ["y"])[2][0] != h[4]
    assert [len(x) for x in extraction.run_hashes([b"", b"a"], ["x", "x"])] == [0, 0, 0]


def test_runs_are_sent_once_or_twice_and_counted_by_bucket():
    rng = np.random.default_rng(3)
    hashes = np.concatenate([rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2), np.full(500, 7, np.uint64), np.full(4, 9, np.uint64)])
    contents = np.concatenate([rng.integers(-9, 9, 800), np.full(4, -3)])
    batch = extraction.dealt([(hashes[:450], contents[:450]), (hashes[450:], contents[450:])])
    got = {}
    for bucket, h, c in zip(*(batch.column(k).to_pylist() for k in ("bucket", "h", "contents"))):
        for x, y in zip(np.frombuffer(h, np.uint64).tolist(), np.frombuffer(c, np.int64).tolist()):
            assert x >> (64 - extraction.BUCKET_BITS) == bucket
            got.setdefault(x, []).append(y)
    want = {}
    for x, y in zip(hashes.tolist(), contents.tolist()):
        want.setdefault(x, set()).add(y)
    assert got == {x: sorted({min(v), max(v)}) for x, v in want.items()}
    assert batch.num_rows == len({x >> (64 - extraction.BUCKET_BITS) for x in want})
    found = extraction.shared_runs([(hashes, contents)]).column("h").to_numpy().view(np.uint64)
    assert found.tolist() == sorted(x for x, v in want.items() if len(v) > 1)
    none = [(hashes[:0], contents[:0])]
    assert extraction.dealt(none).num_rows == extraction.shared_runs(none).num_rows == 0


def test_parts_of_a_table_give_the_same_repeats(spark):
    run = " ".join(f"w{i}" for i in range(9))
    rows = [(f"{run} {i}", "h", i) for i in range(6)] + [(run, "other", 6), ("few words", "h", 7)]
    pages = spark.createDataFrame(rows, "lines string, host string, content long").repartition(3)
    whole = {r.content: sorted(r.found) for r in extraction.repeated_runs(pages).collect()}
    assert whole == {i: [0, 1] for i in range(6)}
    parts = [pages.where(f"content % 2 = {k}") for k in range(2)]
    assert {r.content: sorted(r.found) for r in extraction.repeated_runs(pages, wanted=parts).collect()} == whole
    assert {r.content: sorted(r.found) for r in extraction.repeated_runs(pages, wanted=parts[:1]).collect()} == {i: [0, 1] for i in (0, 2, 4)}


def test_extract_leaves_only_its_texts_on_disk(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*/*.parquet")) | set(folder.glob("*/*/*.parquet"))
    table = spark.createDataFrame([(i, f"http://h/{i}", PAGE + str(i)) for i in range(9)], "page_id long, url string, html string")
    found = extraction.extract(table)
    left = (set(folder.glob("*/*.parquet")) | set(folder.glob("*/*/*.parquet"))) - before
    assert left and {p.parent.name.rsplit("-", 5)[0] for p in left} == {"texts"}
    assert found.count() == 9
