"""The sample star schema that the questions' known answers refer to."""

import datetime as dt

# The rows of the sample, without the columns that no answer depends on.
REGIONS = [(1, "South", "Bangalore"), (2, "South", "Chennai"), (3, "South", "Hyderabad"), (4, "West", "Mumbai"), (5, "West", "Pune"), (6, "North", "Delhi"), (7, "North", "Jaipur"), (8, "East", "Kolkata")]
CUSTOMERS = [
    (1, "Rahul Sharma", "Bangalore"),
    (2, "Priya Patel", "Mumbai"),
    (3, "Amit Kumar", "Delhi"),
    (4, "Sneha Reddy", "Hyderabad"),
    (5, "Vikram Singh", "Jaipur"),
    (6, "Ananya Das", "Kolkata"),
    (7, "Karthik Nair", "Chennai"),
    (8, "Deepa Gupta", "Pune"),
    (9, "Rajesh Iyer", "Bangalore"),
    (10, "Meera Joshi", "Mumbai"),
]
PRODUCTS = [
    (1, "Laptop Pro", "Electronics", 75000.0),
    (2, "Wireless Mouse", "Electronics", 1500.0),
    (3, "Office Chair", "Furniture", 12000.0),
    (4, "Standing Desk", "Furniture", 25000.0),
    (5, 'Monitor 27"', "Electronics", 22000.0),
    (6, "Keyboard Mechanical", "Electronics", 3500.0),
    (7, "Webcam HD", "Electronics", 4000.0),
    (8, "Desk Lamp", "Furniture", 2500.0),
    (9, "USB Hub", "Electronics", 1800.0),
    (10, "Notebook Pack", "Stationery", 500.0),
]
# (customer, date, amount) of orders 1, 2, ...
ORDERS = [
    (1, "2025-01-15", 76500.0), (2, "2025-01-22", 25000.0), (3, "2025-02-10", 45500.0), (4, "2025-02-18", 3500.0), (5, "2025-03-05", 75000.0), (6, "2025-03-20", 14500.0),
    (7, "2025-04-01", 22000.0), (8, "2025-04-15", 27500.0), (9, "2025-05-10", 150000.0), (10, "2025-05-25", 9000.0), (1, "2025-06-12", 4000.0), (2, "2025-07-08", 51500.0),
    (3, "2025-08-14", 12000.0), (4, "2025-09-03", 76500.0), (5, "2025-10-18", 25500.0), (6, "2025-11-22", 97000.0), (7, "2025-12-10", 37500.0), (8, "2026-01-15", 22000.0),
    (9, "2026-02-20", 150500.0), (10, "2026-03-10", 76500.0), (1, "2026-03-25", 25000.0), (2, "2026-04-05", 44000.0), (3, "2026-04-12", 3500.0),
]
# (order, product, quantity, region) of sales 1, 2, ...; a sale has its order's date and its product's price.
SALES = [
    (1, 1, 1, 1), (1, 2, 1, 1), (2, 4, 1, 4), (3, 5, 1, 6), (3, 6, 1, 6), (3, 3, 1, 6), (3, 9, 1, 6), (4, 6, 1, 3), (5, 1, 1, 7), (6, 3, 1, 8), (6, 8, 1, 8), (7, 5, 1, 2),
    (8, 4, 1, 5), (8, 8, 1, 5), (9, 1, 2, 1), (10, 7, 1, 4), (10, 10, 10, 4), (11, 7, 1, 1), (12, 1, 1, 4), (12, 2, 1, 4), (13, 3, 1, 6), (14, 1, 1, 3), (14, 2, 1, 3), (15, 4, 1, 7),
    (15, 10, 1, 7), (16, 1, 1, 8), (16, 5, 1, 8), (17, 6, 5, 2), (17, 5, 1, 2), (18, 5, 1, 5), (19, 1, 2, 1), (19, 10, 1, 1), (20, 1, 1, 4), (20, 2, 1, 4), (21, 4, 1, 1), (22, 5, 2, 4),
    (23, 6, 1, 6),
]


def tables(spark):
    """The tables by name, with the catalog's keys."""
    from tidemark.sources.catalog import Keys

    day = dt.date.fromisoformat
    orders = [(k, c, day(d), a, "completed") for k, (c, d, a) in enumerate(ORDERS, 1)]
    sales = [(k, o, p, n, PRODUCTS[p - 1][3], n * PRODUCTS[p - 1][3], orders[o - 1][2], r) for k, (o, p, n, r) in enumerate(SALES, 1)]
    make = spark.createDataFrame
    return {
        "regions": (make(REGIONS, "region_id long, region_name string, city string"), Keys(("region_id",))),
        "customers": (make(CUSTOMERS, "customer_id long, name string, city string"), Keys(("customer_id",))),
        "products": (make(PRODUCTS, "product_id long, product_name string, category string, price double"), Keys(("product_id",))),
        "orders": (make(orders, "order_id long, customer_id long, order_date date, total_amount double, status string"), Keys(("order_id",), {"customer_id": ("customers", "customer_id")}, {"status": "completed"})),
        "sales": (
            make(sales, "sale_id long, order_id long, product_id long, quantity long, unit_price double, total_price double, sale_date date, region_id long"),
            Keys(("sale_id",), {"order_id": ("orders", "order_id"), "product_id": ("products", "product_id"), "region_id": ("regions", "region_id")}),
        ),
    }
