"""Small invented datasets, written by rule so that their truths can be worked out by hand."""

import datetime

from lakegauge.dataset import Dataset, DeclaredKey

START = datetime.date(2025, 4, 1)
FIRST = ("Alma", "Bruno", "Celia", "Dario", "Edda", "Falk", "Greta", "Hugo", "Ines", "Jonte", "Karla", "Leif", "Mona")
LAST = ("Lund", "Moss", "Nash")
CITIES = ("Oslo", "Turin", "Quito")
# name, kind, price of what is booked
SCREENS = (("Spring Screen", "Wide", 1200), ("Summit Screen", "Wide", 2500), ("Iron Panel", "Narrow", 800),
           ("Pulse Panel", "Narrow", 650), ("Lung Panel", "Narrow", 1900))


def person(i):
    return f"{FIRST[i % 13]} {LAST[i % 3]}"


def bookings(spark):
    """24 visits of 13 customers; visits 5 and 17 are cancelled, those from 13 on are repeats.

    Two visits are booked each eighth day and reported two and five days later.
    """
    out = []
    for i in range(24):
        who, (name, kind, price) = i % 13, SCREENS[i % 5]
        booked = START + datetime.timedelta(8 * (i // 2))
        reported = booked + datetime.timedelta(2 + 3 * (i % 2))
        lost = i in (5, 17)
        out.append((f"V{i:03d}", f"P{who:02d}", person(who), 600_000_000 + 7919 * who, CITIES[who % 3], name, kind,
                    f"{CITIES[who % 3]} Lab", booked, reported, price, "Pending" if lost else "Paid",
                    "Yes" if i >= 13 else "No", f"H{who:02d}", 25 + 3 * who, "FM"[who % 2], "Cancelled" if lost else "Completed"))
    schema = (
        "booking_id string, customer_id string, customer_name string, phone bigint, city string, package_name string, "
        "package_category string, lab_partner string, booking_date date, report_delivery_date date, amount_inr bigint, "
        "payment_status string, is_repeat_customer string, household_id string, age bigint, gender string, status string"
    )
    return Dataset({"bookings": spark.createDataFrame(out, schema)})


def retail(spark):
    """9 customers in 4 cities, 20 orders of seven sizes, 22 lines; orders 4, 15 are cancelled and 9, 12 returned."""
    towns = (*CITIES, "Perth")
    customers = [
        (f"K{i:02d}", person(i), f"{FIRST[i].lower()}@example.org", datetime.date(2023, 1, 5) + datetime.timedelta(20 * i),
         towns[i % 4], ("Gold", "Silver", "Bronze")[i % 3])
        for i in range(9)
    ]
    orders = []
    for i in range(20):
        who = 4 * i % 9
        status = "cancelled" if i in (4, 15) else "returned" if i in (9, 12) else "delivered"
        orders.append((f"R{i:03d}", f"K{who:02d}", datetime.date(2024, 3, 1) + datetime.timedelta(3 * i), status,
                       ("card", "cash", "bank")[i % 3], towns[who % 4], 120.5 + 40 * (i % 7)))
    goods = (("Kettle", "Kitchen"), ("Rope", "Sport"), ("Stool", "Home"), ("Whisk", "Kitchen"), ("Tent", "Sport"), ("Rug", "Home"), ("Sieve", "Kitchen"))
    items = [(f"L{j:02d}", f"R{j % 20:03d}", *goods[j % 7], 1 + j % 3, 15.25 + 10 * (j % 6)) for j in range(22)]
    return Dataset({
        "customers": spark.createDataFrame(
            customers, "customer_id string, full_name string, email_address string, signup_date date, city string, loyalty_tier string"),
        "orders": spark.createDataFrame(
            orders, "order_id string, customer_id string, order_date date, order_status string, payment_method string, "
            "shipping_city string, order_total double"),
        "order_items": spark.createDataFrame(
            items, "order_item_id string, order_id string, product_name string, product_category string, quantity bigint, unit_price double"),
    })


def edtech(spark):
    students = [(i, person(i), f"{FIRST[i].lower()}@example.org", f"2024-0{1 + i % 2}-15", f"Year {7 + i % 3}") for i in range(1, 8)]
    courses = [(201, "Pottery", "Arts", 310.0), (202, "Botany", "Science", 420.0), (203, "Chess", "Games", 150.0), (204, "Welding", "Crafts", 560.0)]
    enrollments = [
        (1, 1, 201, "2024-02-03", "active", 61.0), (2, 2, 201, "2024-02-09", "completed", 73.5), (3, 3, 201, "2024-02-20", "active", 58.25),
        (4, 4, 202, "2024-03-02", "active", 90.0), (5, 5, 202, "2024-03-02", "dropped", None), (6, 6, 202, "2024-03-11", "completed", 66.75),
        (7, 7, 203, "2024-03-19", "active", 84.5), (8, 1, 203, "2024-03-28", "active", 49.0), (9, 2, 204, "2024-04-04", "active", 77.0),
        (10, 3, 204, "2024-04-15", "active", 95.0),
    ]
    tables = {
        "students": spark.createDataFrame(
            students, "student_id bigint, full_name string, email string, enrolled_since string, grade_level string"),
        "courses": spark.createDataFrame(courses, "course_id bigint, course_name string, subject string, price_inr double"),
        "enrollments": spark.createDataFrame(
            enrollments, "enrollment_id bigint, student_id bigint, course_id bigint, enrolled_on string, status string, score double"),
    }
    keys = (
        DeclaredKey("enrollments", "student_id", "students", "student_id"),
        DeclaredKey("enrollments", "course_id", "courses", "course_id"),
    )
    return Dataset(tables, keys, "sqlite")


def survey(spark):
    """100 answers with a fault in each column: shares are given as the row numbers at which a value ends."""

    def pick(i, *shares):
        return next(value for value, end in shares if i < end)

    rows = [
        (
            i + 1,
            pick(i, ("open", 85), ("yes", 95), ("no", 100)),
            pick(i, ("S", 40), ("small", 70), ("L", 90), ("Small", 100)),
            pick(i, ("low", 40), ("mid", 70), ("7", 100)),
            pick(i, (None, 60), ("calm", 100)),
            pick(i, ("north", 94), ("south", 100)),
            "on",
        )
        for i in range(100)
    ]
    schema = "row_no bigint, verdict string, cut string, band string, mood string, site string, state_flag string"
    return Dataset({"survey": spark.createDataFrame(rows, schema)})


def bridge(spark):
    return Dataset({
        "readers": spark.createDataFrame([("r1", "Alma"), ("r2", "Falk"), ("r3", "Mona")], "reader_id string, name string"),
        "books": spark.createDataFrame([("b1", "Tides"), ("b2", "Dunes")], "book_id string, title string"),
        "loans": spark.createDataFrame(
            [("r1", "b1"), ("r1", "b2"), ("r2", "b1"), ("r2", "b2"), ("r3", "b1")], "reader_id string, book_id string"),
    })
