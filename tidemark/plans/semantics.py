"""What business terms mean on a set of tables: metrics, dimensions, dates, places and how the tables join."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Metric:
    """An aggregate of one column; its words are looked for in questions."""

    name: str
    table: str
    column: str
    words: tuple[str, ...]


@dataclass(frozen=True)
class Dimension:
    """A column to group by. key: a column that tells rows of equal names apart."""

    name: str
    table: str
    column: str
    words: tuple[str, ...]
    key: str | None = None


@dataclass(frozen=True)
class Join:
    table: str
    column: str
    to_table: str
    to_column: str


@dataclass(frozen=True)
class Semantics:
    metrics: tuple[Metric, ...]
    dimensions: tuple[Dimension, ...]
    joins: tuple[Join, ...]
    date: tuple[str, str]
    #: Words for whole tables, which can be listed and counted.
    entities: dict[str, str] = field(default_factory=dict)
    #: For each table that places are asked of: the (table, column) that names its place.
    places: dict[str, tuple[str, str]] = field(default_factory=dict)
    categories: tuple[str, str] | None = None

    def metric(self, name: str) -> Metric:
        return next(m for m in self.metrics if m.name == name)

    def dimension(self, name: str) -> Dimension:
        return next(d for d in self.dimensions if d.name == name)

    def named_columns(self) -> dict[str, tuple[str, ...]]:
        """{table: columns} whose values questions name."""
        pairs = [(d.table, d.column) for d in self.dimensions] + [*self.places.values()] + ([self.categories] if self.categories else [])
        return {t: tuple(dict.fromkeys(c for of, c in pairs if of == t)) for t, _ in pairs}

    def path(self, start: str, targets: list[str]) -> list[Join]:
        """The joins, in order, that lead from a table to all the targets by the fewest steps."""
        came: dict[str, tuple[str, Join] | None] = {start: None}
        queue = deque([start])
        while queue:
            at = queue.popleft()
            for j in self.joins:
                if j.table == at and j.to_table not in came:
                    came[j.to_table] = (at, j)
                    queue.append(j.to_table)
        out: list[Join] = []
        for target in targets:
            if target not in came:
                raise ValueError(f"no join leads from {start} to {target}")
            way = []
            while (step := came[target]) is not None:
                way.append(step[1])
                target = step[0]
            out += [j for j in reversed(way) if j not in out]
        return out


#: The driver's star schema.
TPCH = Semantics(
    metrics=(
        Metric("units", "lineitem", "l_quantity", ("units", "quantity", "best selling", "most sold")),
        Metric("order_value", "orders", "o_totalprice", ("order value", "order total")),
        Metric("revenue", "lineitem", "l_extendedprice", ("revenue", "sales", "turnover")),
    ),
    dimensions=(
        Dimension("customer", "customer", "c_name", ("customer", "customers"), "c_custkey"),
        Dimension("category", "part", "p_type", ("product category", "category", "categories")),
        Dimension("product", "part", "p_name", ("product", "products"), "p_partkey"),
        Dimension("city", "nation", "n_name", ("city", "cities", "nation", "country")),
        Dimension("region", "region", "r_name", ("region", "regions")),
    ),
    joins=(
        Join("lineitem", "l_orderkey", "orders", "o_orderkey"),
        Join("lineitem", "l_partkey", "part", "p_partkey"),
        Join("orders", "o_custkey", "customer", "c_custkey"),
        Join("customer", "c_nationkey", "nation", "n_nationkey"),
        Join("nation", "n_regionkey", "region", "r_regionkey"),
    ),
    date=("orders", "o_orderdate"),
    entities={"customers": "customer", "products": "part", "orders": "orders", "regions": "region"},
    places={"customer": ("nation", "n_name"), "lineitem": ("nation", "n_name"), "orders": ("nation", "n_name")},
    categories=("part", "p_type"),
)

#: The sample star schema: customers, products, regions, orders and sales.
SAMPLE = Semantics(
    metrics=(
        Metric("units", "sales", "quantity", ("units", "quantity", "best selling", "most sold")),
        Metric("order_value", "orders", "total_amount", ("order value", "order total")),
        Metric("revenue", "sales", "total_price", ("revenue", "sales", "turnover")),
    ),
    dimensions=(
        Dimension("customer", "customers", "name", ("customer", "customers"), "customer_id"),
        Dimension("category", "products", "category", ("product category", "category", "categories")),
        Dimension("product", "products", "product_name", ("product", "products"), "product_id"),
        Dimension("city", "regions", "city", ("city", "cities")),
        Dimension("region", "regions", "region_name", ("region", "regions")),
    ),
    joins=(
        Join("sales", "order_id", "orders", "order_id"),
        Join("sales", "product_id", "products", "product_id"),
        Join("sales", "region_id", "regions", "region_id"),
        Join("orders", "customer_id", "customers", "customer_id"),
    ),
    date=("sales", "sale_date"),
    entities={"customers": "customers", "products": "products", "orders": "orders", "regions": "regions"},
    places={"customers": ("customers", "city"), "sales": ("regions", "city"), "orders": ("customers", "city")},
    categories=("products", "category"),
)
