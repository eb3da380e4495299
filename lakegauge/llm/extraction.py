"""Main text of web pages: structure first, then what the pages of a host repeat.

A page is cut into blocks, each with what its place in the page says: inside the
article, or inside a menu, header, footer, sidebar, notice, advert, form or
comments.  A substring of ``LEAST_RUN`` tokens or more that stands on pages of one
host with different contents is repeated, and is boilerplate where the page does
not mark it as part of its article.  Of pages that mark no article, the unique
runs stay.  Tables find it by a grouping of all runs of a host, whatever its size;
``main_texts`` by a suffix array over the pages given to it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegauge.llm.common import conf_set, erased, new_path, written
from lakegauge.llm.phrases import Filter, _filter

#: Tokens from which a repeated substring counts; a power of two, the last order the suffixes are sorted to.
LEAST_RUN = 8
#: Parts that the hashes of all runs are counted in, one after another.
SLICES = 5
#: Parts of the pages that are put together with their repeats, one after another.
PARTS = 4
#: Pages whose tokens a task holds at once.
AT_ONCE = 128
#: Runs that a task sorts before it sends them, and bits of a hash that name the bucket they are sent to.
RUNS = 1 << 20
BUCKET_BITS = 12
#: Bits of the filter of repeated runs, eight for each of them and these at most; 32 MB.
FILTER_BITS = 1 << 28

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; those of RAW end only at their own end tag.
RAW = frozenset("script style textarea title xmp noscript noembed noframes iframe template svg math".split())
SKIPPED = RAW | frozenset("head select button object canvas audio video datalist".split())
LABELLED = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words that say, as a whole class or id or beside words of PLACES alone, what an element is.
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal "
    "overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments reply replies respond "
    "disqus share sharing social related newsletter subscribe signup login widget pagination pager toolbar".split()
)
PLACES = frozenset(
    "site page main global primary secondary top bottom left right inner outer header bar box block area section container wrapper wrap list "
    "item items links link buttons button icons panel unit slot posts post form content inline fixed sticky mobile desktop".split()
)
#: Start tags that end an open element of the same kind.
SIBLINGS = {t: frozenset(s.split()) for t, s in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}


def is_sign(name: str) -> bool:
    """Whether a class or id names boilerplate: ``site-footer`` does, ``with-sidebar`` and ``notice-board`` do not."""
    words = _WORDS.findall(name)
    return not SIGNS.isdisjoint(words) and all(w in SIGNS or w in PLACES or w.isdigit() for w in words)


def _label(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """(boilerplate, article, hidden) as the element's name and attributes say."""
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    signs = any(map(is_sign, f"{found.get('class', '')} {found.get('id', '')}".split()))
    article = tag in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"
    boilerplate = signs or tag in LABELLED or found.get("role") in ROLES or (tag == "header" and not in_article)
    return boilerplate and tag not in ("html", "body"), article, hidden


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in an article, boilerplate by its place) of each block, in page order.

    Where all that a page shows would be boilerplate, what holds its articles is
    not: only what an article says of itself and of its own parts counts.
    """
    found = _blocks(page or "", False)
    if any(article for _, article, _ in found) and all(boilerplate for _, _, boilerplate in found):
        return _blocks(page or "", True)
    return found


def _blocks(source: str, articles_stand: bool) -> list[tuple[str, bool, bool]]:
    """The blocks; with ``articles_stand`` an outermost article takes nothing from the elements round it."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, in an article, boilerplate
    piece: list[tuple[str, bool, bool]] = []  # what stands in the open block; elements inside a line may differ from it
    skipped, at, article, boilerplate, name = 0, 0, False, False, ""

    def flush() -> None:
        for state in dict.fromkeys(p[1:] for p in piece):
            text = " ".join(html.unescape("".join(p[0] for p in piece if p[1:] == state)).split())
            if text:
                out.append((text, *state))
        piece.clear()

    def close(tag: str) -> None:
        nonlocal article, boilerplate
        while stack and stack.pop()[0] != tag:
            pass
        article, boilerplate = stack[-1][1:] if stack else (False, False)

    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if not skipped and m.start() > at:
            piece.append((source[at : m.start()], article, boilerplate))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if not skipped and m[0].startswith("<![CDATA["):
                piece.append((html.escape(m[0][9:-3]), article, boilerplate))
            continue
        if m[1]:
            if skipped:
                if tag == name:
                    skipped -= 1
                continue
            if tag in BLOCKS:
                flush()
            if tag == "p" and all(e[0] != "p" for e in stack):
                continue
            if any(e[0] == tag for e in stack):
                close(tag)
            continue
        if skipped:
            skipped += tag == name and not m[3].endswith("/")
            continue
        if tag in RAW or tag in SKIPPED:
            if m[3].endswith("/"):
                continue
            if tag in RAW:  # what looks like a tag inside is not one
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            else:
                skipped, name = 1, tag
            continue
        if tag in BLOCKS:
            flush()
            if any(e[0] == "p" for e in stack):
                close("p")
            if tag in SIBLINGS and stack and any(e[0] in SIBLINGS[tag] for e in stack[-3:]):
                close(next(e[0] for e in reversed(stack) if e[0] in SIBLINGS[tag]))
        if tag == "br":
            piece.append(("\n", article, boilerplate))
        if tag in VOID or m[3].endswith("/"):
            continue
        labelled, main, hidden = _label(tag, m[3], article)
        inherited = boilerplate and not (articles_stand and main and not article)
        stack.append((tag, article or main, inherited or labelled or hidden))
        article, boilerplate = stack[-1][1:]
    if not skipped and at < len(source):
        piece.append((source[at:], article, boilerplate))
    flush()
    return out


def repeated(tokens: np.ndarray, pages: np.ndarray, run: int = LEAST_RUN) -> np.ndarray:
    """Which positions lie in a substring of ``run`` tokens or more that stands on different pages.

    ``pages`` rises along ``tokens``.  The suffixes are sorted by their first one,
    two, four ... ``run`` tokens, each order from the one before; suffixes that are
    equal that far stand side by side.  A longer repeat is a chain of such.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(n, bool)
    rank, size = tokens.astype(np.int64) + 1, 1
    last = np.searchsorted(pages, pages, side="right")  # the end of each position's page
    while size < run:
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(np.arange(n) + size < last)
        after[inside] = rank[inside + size]
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        size *= 2
    suffixes = np.argsort(rank, kind="stable")
    suffixes = suffixes[suffixes + run <= last[suffixes]]
    if not len(suffixes):
        return np.zeros(n, bool)
    own = rank[suffixes]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    page = pages[suffixes]
    apart = np.minimum.reduceat(page, starts) != np.maximum.reduceat(page, starts)
    found = suffixes[np.repeat(apart, np.diff(np.append(starts, len(own))))]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + run, -1)
    return np.cumsum(edge)[:n] > 0


def _whole_runs(covered: np.ndarray, run: int = LEAST_RUN) -> np.ndarray:
    """The covered tokens of a block without the ends of runs that belong to the blocks beside it."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    out = covered.copy()
    for a, b in edge.reshape(-1, 2):
        if b - a < min(run, len(covered)):
            out[a:b] = False
    return out


def _marks_article(own: list[tuple[str, bool, bool]]) -> bool:
    return any(article and not boilerplate for _, article, boilerplate in own)


def _main_text(own: list[tuple[str, bool, bool]], covered: np.ndarray) -> str:
    """The text of a page's blocks, of whose tokens ``covered`` are repeated."""
    if _marks_article(own):
        return "\n".join(text for text, article, boilerplate in own if article and not boilerplate)
    kept, at = [], 0
    for text, _, boilerplate in own:
        words = text.split()
        if not boilerplate:
            unique = [w for w, c in zip(words, _whole_runs(covered[at : at + len(words)]).tolist()) if not c]
            if unique:
                kept.append(" ".join(unique))
        at += len(words)
    return "\n".join(kept)


def main_texts(pages: list[str | None]) -> tuple[list[str], list[int], list[int]]:
    """(text, number of tokens, number of repeated tokens) of each of a host's pages; copies of a page count once."""
    place: dict[str | None, int] = {}
    copies = [place.setdefault(p, len(place)) for p in pages]
    cut = [blocks(p) for p in place]
    number: dict[str, int] = {}
    words = [[w for b in own for w in b[0].split()] for own in cut]
    lengths = [len(own) for own in words]
    tokens = np.fromiter((number.setdefault(w, len(number)) for own in words for w in own), np.int64, sum(lengths))
    covered = repeated(tokens, np.repeat(np.arange(len(cut)), lengths))
    parts = np.split(covered, np.cumsum(lengths)[:-1])
    texts, shared = [_main_text(own, c) for own, c in zip(cut, parts)], [int(c.sum()) for c in parts]
    return [texts[i] for i in copies], [lengths[i] for i in copies], [shared[i] for i in copies]


def _numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd numbers of 64 bits."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed) | 1 for i in range(n)], np.uint64)


#: Numbers of the values of a byte, and factors of a run's tokens and of its host.
_OF_BYTE, _OF_PLACE = _numbers(256, 1), _numbers(LEAST_RUN + 1, 2)
_BASE, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def run_hashes(pages: list[bytes], hosts: list[str], run: int = LEAST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, place, hash) of the ``run`` tokens from each place of the pages on; the hash depends on the host, too.

    Tokens have one blank or line break between them.  A token's hash is a
    polynomial of its bytes, mixed; a run's a weighted sum of its tokens', mixed.
    """
    none = np.zeros(0, np.int64)
    held = [i for i, p in enumerate(pages) if p]
    if not held:
        return none, none, none.view(np.uint64)
    text = np.frombuffer(b"\n".join(pages[i] for i in held) + b"\n", np.uint8)
    ends = np.flatnonzero((text == 0x20) | (text == 0x0A))
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends + 1 - starts
    powers = np.multiply.accumulate(np.full(int(sizes.max()), _BASE))
    letters = _OF_BYTE[text] * powers[np.arange(len(text)) - np.repeat(starts, sizes)]
    letters[ends] = 0
    tokens = _mixed(np.add.reduceat(letters, starts))
    page_ends = np.cumsum([len(pages[i]) + 1 for i in held])
    last = np.searchsorted(starts, page_ends)  # the token after each page's last
    lengths = np.diff(last, prepend=0)
    if len(tokens) < run:
        return none, none, none.view(np.uint64)
    n = len(tokens) - run + 1
    found = tokens[:n] * _OF_PLACE[0]
    for k in range(1, run):
        found += tokens[k : n + k] * _OF_PLACE[k]
    page = np.repeat(np.arange(len(held)), lengths)[:n]
    inside = np.flatnonzero(np.arange(n) + run <= last[page])
    page = page[inside]
    host = np.array([xxhash.xxh64_intdigest(hosts[i].encode("utf-8", "surrogatepass")) for i in held], np.uint64)
    found = _mixed(found[inside] + host[page] * _OF_PLACE[run])
    return np.array(held, np.int64)[page], inside - (last - lengths)[page], found


def _ends(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, smallest content, largest content) of each of the runs ``held`` as (hashes, contents), by rising hash."""
    h, content = (np.concatenate(v) for v in zip(*held))
    order = np.argsort(h)
    h, content = h[order], content[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(first):
        return h, content, content
    return h[first], np.minimum.reduceat(content, first), np.maximum.reduceat(content, first)


def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (bucket, h, contents) of runs: of each run its smallest and its largest content, by buckets of the hash."""
    h, low, high = _ends(held)
    twice = np.where(low < high, 2, 1)
    content = np.repeat(low, twice)
    content[(np.cumsum(twice) - 1)[low < high]] = high[low < high]
    h = np.repeat(h, twice)
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else np.zeros(0, np.int64)
    cut = list(zip(start.tolist(), [*start[1:].tolist(), len(h)]))
    packed = [pa.array([v[a:b].tobytes() for a, b in cut], pa.binary()) for v in (h, content)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[start], pa.int32()), *packed], ["bucket", "h", "contents"])


def shared_runs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (h) of the runs that have different contents."""
    h, low, high = _ends(held)
    return pa.RecordBatch.from_arrays([pa.array(h[low < high].view(np.int64))], ["h"])


def covered_tokens(starts: list[int], n_tokens: int) -> np.ndarray:
    """Which of a page's tokens lie in the runs that begin at ``starts``."""
    covered = np.zeros(n_tokens, bool)
    for at in starts:
        covered[at : at + LEAST_RUN] = True
    return covered


def repeated_runs(pages: DataFrame, slices: int = SLICES, wanted: list[DataFrame] | None = None) -> DataFrame:
    """Written rows (content, found): where runs begin in a page that stand in another content of its host, too.

    ``pages`` has rows (lines, host, content), the page's blocks a line each.  The
    runs' hashes are counted a slice at a time, each giving its shuffle back, so
    that the disk holds a part of them: tasks send a run's smallest and largest
    content to the bucket of its hash, many runs a row, and a bucket is sorted as
    a whole.  What a filter of the repeated ones lets through is joined with them.
    Of the pages in ``wanted`` only, if given, one table after another.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(content, place, hash) of the runs of some pages at once."""
        for batch in batches:
            for s in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(s, AT_ONCE)
                page, place, h = run_hashes(part.column("lines").cast(pa.binary()).to_pylist(), part.column("host").to_pylist())
                yield part.column("content").to_numpy()[page], place, h

    def repeats(k: int) -> DataFrame:
        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for content, _, h in hashed(batches):
                own = np.flatnonzero((h >> np.uint64(40)) % np.uint64(slices) == k)
                held.append((h[own], content[own]))
                if sum(len(v) for v, _ in held) >= RUNS:
                    yield dealt(held)
                    held = []
            if held:
                yield dealt(held)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            now = None
            for batch in batches:
                for bucket, *pair in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "contents"))):
                    if bucket != now and held:
                        yield shared_runs(held)
                        held = []
                    now = bucket
                    held.append((np.frombuffer(pair[0], np.uint64), np.frombuffer(pair[1], np.int64)))
            if held:
                yield shared_runs(held)

        with conf_set(pages.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "256"):  # many runs a row
            buckets = pages.mapInArrow(runs, "bucket int, h binary, contents binary").repartition("bucket").sortWithinPartitions("bucket")
            return written(buckets.mapInArrow(counted, "h long"), "repeats", free=True)

    many = reduce(DataFrame.unionByName, [repeats(k) for k in range(slices)])
    bits = min(FILTER_BITS, max(1 << 20, 1 << (8 * many.count()).bit_length()))
    shared = pages.sparkSession.sparkContext.broadcast(_filter(many, bits))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = Filter(shared.value)
        for content, place, h in hashed(batches):
            own = np.flatnonzero(repeated.has(h))
            yield pa.RecordBatch.from_arrays([pa.array(v[own]) for v in (content, h.view(np.int64), place.astype(np.int32))], ["content", "h", "at"])

    def places(some: DataFrame) -> DataFrame:
        found = some.mapInArrow(possible, "content long, h long, at int").join(many, "h", "left_semi")
        return written(found.groupBy("content").agg(F.collect_set("at").alias("found")), "found", free=True)

    found = reduce(DataFrame.unionByName, [places(some) for some in wanted or [pages]])
    shared.destroy()
    erased(many)
    return found


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", counts: bool = True, slices: int = SLICES
) -> DataFrame:
    """Rows (page_id, url, text, n_tokens, n_repeated) for each row of ``pages``.

    A null page is empty and has the empty text; pages whose url names no host
    are one host.  Rows of a host with the same content are one page, so copies
    repeat nothing of each other.  Without ``counts``, ``n_repeated`` is null for
    pages that mark an article, and hosts that have only such are not compared.
    An empty table gives no rows.  A page is parsed once: its blocks are written
    in parts, each deleted when its texts are, and its runs are taken from them.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.coalesce(F.try_parse_url(F.col(url_col), F.lit("HOST")), F.lit("")).alias("host"),
    ).withColumn("content", F.xxhash64("host", "html"))

    def structure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [blocks(p) for p in batch.column("html").to_pylist()]
            lines = ["\n".join(b[0] for b in own) for own in cut]  # a block's tokens have one space between them
            marks = [bytes(article + 2 * boilerplate for _, article, boilerplate in own) for own in cut]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host", "content")),
                 pa.array(lines, pa.string()), pa.array(marks, pa.binary()), pa.array([not _marks_article(own) for own in cut], pa.bool_())],
                ["page_id", "url", "host", "content", "lines", "marks", "open"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, shared = [], [], []
            for lines, marks, open_, found in zip(*(batch.column(c).to_pylist() for c in ("lines", "marks", "open", "found"))):
                own = [(text, bool(m & 1), bool(m & 2)) for text, m in zip(lines.split("\n"), marks)]
                sizes.append(len(lines.split()))
                covered = covered_tokens(found or [], sizes[-1])
                texts.append(_main_text(own, covered))
                shared.append(int(covered.sum()) if counts or open_ else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())],
                ["page_id", "url", "text", "n_tokens", "n_repeated"])

    spark, returned = pages.sparkSession, f"page_id {kind}, url string, text string, n_tokens long, n_repeated long"
    path, part_of = new_path(spark, "structure"), F.pmod("content", F.lit(PARTS))
    cut_up = rows.select("page_id", "url", "html", "host", "content").mapInArrow(
        structure, f"page_id {kind}, url string, host string, content long, lines string, marks binary, open boolean"
    )
    with conf_set(spark, "spark.sql.parquet.compression.codec", "zstd"), conf_set(spark, "spark.sql.maxConcurrentOutputFileWriters", str(PARTS)):
        cut_up.withColumn("part", part_of).write.partitionBy("part").parquet(path)
    first = spark.read.schema(cut_up.schema.add("part", "long")).parquet(path).drop("part")
    folders = sorted({f.rsplit("/", 1)[0] for f in first.inputFiles()})
    stored = [spark.read.schema(cut_up.schema).parquet(folder) for folder in folders]
    own = first.select("lines", "host", "content")
    if not counts:
        stood = first.where("open").select("host").distinct()
        own = own.join(stood, "host", "left_semi").select("lines", "host", "content")
    found = None
    if counts or not first.where("open").isEmpty():
        found = repeated_runs(own, slices, [(t if counts else t.where("open")).select("lines", "host", "content") for t in stored])
    parts = []
    for folder, whole in zip(folders, stored):  # a part's texts cross the network at a time
        if found is None:
            part = whole.withColumn("found", F.lit(None).cast("array<int>"))
        else:
            part = whole.join(found.where(part_of == int(folder.rsplit("=", 1)[1])), "content", "left")
        part = part.select("page_id", "url", "lines", "marks", "open", "found").mapInArrow(finished, returned)
        with conf_set(spark, "spark.sql.parquet.compression.codec", "zstd"):
            parts.append(written(part, "texts", free=True))
        erased(whole)
    if found is not None:
        erased(found)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], returned)
