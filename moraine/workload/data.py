"""The test tables, and the tables with defects and the fleet derived from them.

The test tables hold no nulls and no orphans, so defects are put in by rules on
ordinary attributes (a negative balance, a status, a segment).  Each rule is one
SQL text that both Spark and the SQL form read; it is the fixture, the operator
under test is written twice.  Everything derived grows with its base table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from moraine.operators.drift import desired_for, literal_rows
from moraine.operators.inventory import ROW_TYPES
from moraine.sources.tables import read_table_set

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

NOW = "2024-06-01 00:00:00"  # the clock of every archived or time-defaulted row

# ------------------------------------------------------------- tables with defects

# derived table: (base table, {column: expression, None for the column as it is}, row filter)
DERIVED = {
    # a migration half way: segment is being copied into segment_new
    "cust": ("customer", {
        "c_custkey": None, "c_name": None, "c_nationkey": None, "c_acctbal": None,
        "c_mktsegment": "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END",
        "segment_new": "CASE WHEN c_nationkey < 10 AND c_acctbal >= 0 THEN lower(c_mktsegment) END",
    }, None),
    # keys kept as text, a few of them no numbers
    "ord_text": ("orders", {
        "o_orderkey": None, "o_orderstatus": None,
        "cust_text": "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'n/a' "
                     "ELSE CAST(o_custkey AS STRING) END",
    }, None),
    # ids that outgrew an integer
    "evt_big": ("events", {
        "event_id": None, "ts": None, "user_id": None, "event_type": None,
        "big_id": "CASE WHEN event_type = 'error' THEN event_id + 3000000000 ELSE event_id END",
    }, None),
    "live_orders": ("orders", {
        "o_orderkey": None, "o_custkey": None, "o_orderstatus": None, "o_totalprice": None, "o_orderdate": None,
        "o_orderpriority": None,
    }, "o_orderstatus <> 'P'"),
    "gone_orders": ("orders", {"o_orderkey": None, "o_custkey": None, "o_orderstatus": None},
                    "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"),
    "gone_customers": ("customer", {
        "c_custkey": None, "c_name": None, "c_nationkey": None, "c_acctbal": None, "c_mktsegment": None,
    }, "c_acctbal < 0"),
    # a later snapshot of orders: some closed, some repriced, some new keys
    "orders_later": ("orders", {
        "o_orderkey": "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN o_orderkey + 100000000 "
                      "ELSE o_orderkey END",
        "o_custkey": None,
        "o_orderstatus": "CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'F' "
                         "ELSE o_orderstatus END",
        "o_totalprice": None,
    }, "o_orderstatus <> 'F' OR o_orderpriority <> '2-HIGH'"),
    # dual writes: value_text is the old column, value_new the converted one, with gaps
    "evt_dual": ("events", {
        "event_id": None, "ts": None, "user_id": None,
        "value_text": "CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(event_id AS STRING) END",
        "value_new": "CASE WHEN event_type IN ('view', 'click', 'signup') THEN event_id END",
    }, None),
    "cust_archive": ("customer", {
        "c_custkey": None, "c_name": None, "c_nationkey": None, "c_acctbal": None, "c_mktsegment": None,
    }, "c_nationkey <> 24"),
}


def _derived_sql(name: str) -> str:
    base, columns, where = DERIVED[name]
    picked = ", ".join(f"{e} AS {c}" if e else c for c, e in columns.items())
    return f"{name} AS (SELECT {picked} FROM {base}" + (f" WHERE {where})" if where else ")")


def using(*names: str) -> str:
    """``WITH`` clause of the SQL form for the derived tables it reads."""
    return "WITH " + ", ".join(_derived_sql(n) for n in names) + " "


# ------------------------------------------------------------------ the fleet

# Each customer is a transport operator with its own copy of this schema (fixed
# values of the test fixture), drifted by the rules below.
_TABLES = [
    {"schema_name": "public", "table_name": t, "rls_enabled": False} for t in ("routes", "stops", "runs", "calls", "fares")
]


def _col(table, ordinal, column, type_raw, nullable, default=None, pk=False):
    return {"schema_name": "public", "table_name": table, "ordinal": ordinal, "column_name": column,
            "type_raw": type_raw, "nullable": nullable, "default_raw": default, "is_pk": pk}


_TS = "timestamp without time zone"
_COLS = [
    _col("routes", 1, "route_id", "integer", False, "nextval('routes_route_id_seq'::regclass)", True),
    _col("routes", 2, "code", "text", False),
    _col("routes", 3, "mode", "varchar(12)", False, "'bus'"),
    _col("routes", 4, "fare_zone", "smallint", True),
    _col("routes", 5, "opened_at", _TS, True, "now()"),
    _col("stops", 1, "stop_id", "integer", False, "nextval('stops_stop_id_seq'::regclass)", True),
    _col("stops", 2, "label", "text", False),
    _col("stops", 3, "lat", "double precision", False),
    _col("stops", 4, "lon", "double precision", False),
    _col("stops", 5, "sheltered", "boolean", True, "false"),
    _col("runs", 1, "run_id", "integer", False, "nextval('runs_run_id_seq'::regclass)", True),
    _col("runs", 2, "route_id", "integer", False),
    _col("runs", 3, "vehicle", "text", False),
    _col("runs", 4, "left_at", _TS, True, "now()"),
    _col("runs", 5, "arrived_at", _TS, True, "now()"),
    _col("runs", 6, "delay_s", "integer", True, "0"),
    _col("runs", 7, "remark", "text", True),
    _col("calls", 1, "run_id", "integer", False, None, True),
    _col("calls", 2, "stop_id", "integer", False, None, True),
    _col("calls", 3, "position", "smallint", False),
    _col("calls", 4, "boarded", "integer", True, "0"),
    _col("fares", 1, "zone", "smallint", False, None, True),
    _col("fares", 2, "amount", "numeric(8,2)", False, "0"),
    _col("fares", 3, "valid_from", "date", True),
]


def _idx(table, name, ordinal, column, unique):
    return {"schema_name": "public", "table_name": table, "index_name": name, "ordinal": ordinal,
            "column_name": column, "is_unique": unique}


_IDX = [
    _idx("routes", "routes_code_key", 1, "code", True),
    _idx("stops", "stops_label_key", 1, "label", True),
    _idx("stops", "stops_place", 1, "lat", False),
    _idx("stops", "stops_place", 2, "lon", False),
    _idx("runs", "runs_route_left", 1, "route_id", False),
    _idx("runs", "runs_route_left", 2, "left_at", False),
    _idx("calls", "calls_stop", 1, "stop_id", False),
]


def _fk(table, name, column, ref_table, ref_column, on_delete):
    return {"schema_name": "public", "table_name": table, "fk_name": name, "ordinal": 1, "column_name": column,
            "ref_table": ref_table, "ref_column": ref_column, "on_delete": on_delete, "on_update": None}


_FKS = [
    _fk("runs", "runs_route_id_fkey", "route_id", "routes", "route_id", "CASCADE"),
    _fk("calls", "calls_run_id_fkey", "run_id", "runs", "run_id", "CASCADE"),
    _fk("calls", "calls_stop_id_fkey", "stop_id", "stops", "stop_id", None),
]
BASE = {"tables": _TABLES, "cols": _COLS, "idx": _IDX, "fks": _FKS}

# rows a rule adds to some tenants
EXTRA = {
    "tables": [({"schema_name": "public", "table_name": "incidents", "rls_enabled": False}, "c_nationkey >= 20")],
    "cols": [
        (_col("routes", 6, "operator", "varchar(20)", True), "c_mktsegment = 'BUILDING'"),
        (_col("incidents", 1, "incident_id", "bigint", False, None, True), "c_nationkey >= 20"),
        (_col("incidents", 2, "details", "jsonb", True, "'{}'"), "c_nationkey >= 20"),
    ],
    "idx": [(_idx("routes", "routes_operator", 1, "operator", False), "c_mktsegment = 'BUILDING'")],
    "fks": [],
}
# how the copies of the base rows differ: row filter, then expressions of changed columns
DRIFT = {
    "tables": ("NOT (table_name = 'stops' AND c_nationkey < 5)", {
        "rls_enabled": "table_name = 'routes' AND c_nationkey IN (10, 11)",
    }),
    "cols": (
        "NOT (table_name = 'stops' AND c_nationkey < 5)"
        " AND NOT (table_name = 'runs' AND column_name = 'route_id' AND c_mktsegment = 'AUTOMOBILE' AND c_acctbal < 1000)"
        " AND NOT (column_name = 'arrived_at' AND c_nationkey BETWEEN 12 AND 14)"
        " AND NOT (column_name = 'amount' AND c_nationkey = 19)", {
            "column_name": "CASE WHEN column_name = 'remark' AND c_mktsegment = 'HOUSEHOLD' THEN 'remarks' "
                           "ELSE column_name END",
            "type_raw": "CASE WHEN column_name = 'vehicle' AND c_mktsegment = 'MACHINERY' THEN 'varchar(200)' "
                        "WHEN table_name = 'routes' AND column_name = 'route_id' AND c_mktsegment = 'FURNITURE' "
                        "AND c_acctbal > 5000 THEN 'int8' "
                        "WHEN table_name = 'routes' AND column_name = 'route_id' AND c_nationkey = 8 THEN 'pg_catalog.int4' "
                        "WHEN column_name IN ('opened_at', 'left_at') AND c_nationkey = 9 THEN 'timestamptz' "
                        "WHEN column_name IN ('opened_at', 'left_at') AND c_nationkey = 6 THEN 'date' "
                        "WHEN column_name IN ('lat', 'lon') AND c_nationkey = 16 THEN 'real' "
                        "WHEN column_name = 'fare_zone' AND c_nationkey = 17 THEN 'integer' ELSE type_raw END",
            "nullable": "CASE WHEN column_name = 'code' AND c_acctbal < 0 THEN true ELSE nullable END",
            "default_raw": "CASE WHEN column_name = 'arrived_at' AND c_acctbal > 9000 THEN NULL "
                           "WHEN column_name IN ('opened_at', 'left_at') AND c_nationkey = 3 THEN 'CURRENT_TIMESTAMP' "
                           "WHEN column_name = 'delay_s' AND c_nationkey = 18 THEN '5' ELSE default_raw END",
            "is_pk": "CASE WHEN table_name = 'calls' AND c_nationkey = 7 THEN false ELSE is_pk END",
        }),
    "idx": (
        "NOT (table_name = 'stops' AND c_nationkey < 5)"
        " AND NOT (index_name = 'runs_route_left' AND c_mktsegment = 'MACHINERY')", {
            "is_unique": "CASE WHEN index_name = 'routes_code_key' AND c_acctbal < 0 THEN false "
                         "WHEN index_name = 'calls_stop' AND c_nationkey = 24 THEN true ELSE is_unique END",
        }),
    "fks": ("NOT (fk_name = 'calls_stop_id_fkey' AND c_nationkey < 5)", {
        "on_delete": "CASE WHEN fk_name = 'runs_route_id_fkey' AND c_mktsegment = 'FURNITURE' THEN NULL "
                     "WHEN fk_name = 'calls_stop_id_fkey' AND c_nationkey = 23 THEN 'RESTRICT' ELSE on_delete END",
    }),
}
_ATTRS = ["c_nationkey", "c_acctbal", "c_mktsegment"]
TENANTS_A_TASK = 4_000  # a tenant unfolds into some eighty rows


def _literal(value) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values_sql(rows: list[dict]) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in r.values()) + ")" for r in rows)
    return f"(VALUES {body}) AS b({', '.join(rows[0])})"


def _fleet_sql(kind: str) -> str:
    rows, (keep, changed) = BASE[kind], DRIFT[kind]
    names = list(rows[0])
    picked = ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in names)
    parts = [f"SELECT c_custkey AS env_id, {picked} FROM customer, {values_sql(rows)} WHERE {keep}"]
    parts += [
        f"SELECT c_custkey, {', '.join(names)} FROM customer, {values_sql([row])} WHERE {where}"
        for row, where in EXTRA[kind]
    ]
    desired = f"SELECT c_custkey AS env_id, {', '.join(names)} FROM customer, {values_sql(rows)}"
    return f"cur_{kind} AS ({' UNION ALL '.join(parts)}), des_{kind} AS ({desired})"


def fleet(*kinds: str) -> str:
    """``WITH`` clause of ``cur_*`` and ``des_*`` inventories for the SQL form."""
    return "WITH " + ", ".join(_fleet_sql(k) for k in kinds) + " "


# ------------------------------------------------------------ the statement log

# Fixed values of the fixture; {t} is replaced by a table name.
STATEMENTS = [
    "CREATE INDEX idx_{t}_ts ON {t} (ts)",
    "create unique index concurrently uq_{t} on {t} (id)",
    "ALTER TABLE {t} ADD CONSTRAINT {t}_amount_ok CHECK (amount > 0)",
    "ALTER TABLE {t} ADD CONSTRAINT {t}_amount_ok CHECK (amount > 0) NOT VALID",
    "ALTER TABLE {t} VALIDATE CONSTRAINT {t}_amount_ok",
    "alter table {t} alter column amount type bigint",
    "ALTER TABLE {t} DROP COLUMN legacy",
    "DROP TABLE {t} CASCADE",
    "TRUNCATE {t}",
    "DELETE FROM {t}",
    "DELETE FROM {t} -- WHERE id = 1",
    "DELETE FROM {t} WHERE note = 'DROP TABLE x'",
    "UPDATE {t} SET amount = 0 WHERE id = 1",
    "INSERT INTO {t} VALUES ('TRUNCATE')",
    "SELECT count(*) FROM {t}",
    "CREATE TABLE IF NOT EXISTS {t}_copy (id integer)",
    "CREATE INDEX IF NOT EXISTS idx_{t}_v ON {t} (v)",
    "BEGIN",
    "CREATE OR REPLACE VIEW v_{t} AS SELECT 1",
    "  ",
    "VACUUM {t}",
    "ALTER TABLE {t} ADD CONSTRAINT CHECK (amount > 0);",
    "CREATE TABLE {t}_new (id integer)",
    "ALTER TABLE {t} ALTER COLUMN amount SET NOT NULL",
    "CREATE UNIQUE INDEX uq_{t}_mail ON {t} (mail)",
    "ALTER TABLE {t} ADD CONSTRAINT fk FOREIGN KEY (a) REFERENCES b (c)",
]


def log_sql() -> str:
    """``WITH`` clause of ``stmt_log``: one row per event."""
    items = ", ".join(_literal(s) for s in STATEMENTS)
    return (
        "WITH stmt_log AS (SELECT user_id AS env_id, CAST(extract('day' FROM ts) AS BIGINT) AS plan_id, "
        "CAST(extract('hour' FROM ts) AS BIGINT) AS step_no, event_id AS stmt_no, "
        f"replace([{items}][CAST(event_id % {len(STATEMENTS)} AS INTEGER) + 1], '{{t}}', event_type) AS sql_text "
        "FROM events) "
    )


class Lazy:
    """An inventory whose frames are built when first used."""

    def __init__(self, build):
        self._build = build

    tables = cached_property(lambda self: self._build("tables"))
    cols = cached_property(lambda self: self._build("cols"))
    idx = cached_property(lambda self: self._build("idx"))
    fks = cached_property(lambda self: self._build("fks"))


class Data:
    """Lazily read test tables and their derivations, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
        if name in DERIVED:
            base, columns, where = DERIVED[name]
            df = getattr(self, base)
            if where:
                df = df.filter(where)
            return df.select(*[F.expr(e).alias(c) if e else F.col(c) for c, e in columns.items()])
        raise AttributeError(name)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table_set(self) -> dict[str, DataFrame]:
        return read_table_set(self.spark, self.folder, SCHEMAS)

    @property
    def now(self):
        return F.expr(f"timestamp_ntz'{NOW}'")

    @cached_property
    def tenants(self) -> DataFrame:
        """The customers, dealt out by environment before anything is unfolded from them.

        Their file is small, so one task would unfold, group and sort the whole
        fleet.  Tasks are as many as the tenants ask for, and rows of an
        environment stay together from here on.
        """
        tasks = -(-self.customer.count() // TENANTS_A_TASK)
        return self.customer.select(F.col("c_custkey").alias("env_id"), *_ATTRS).repartition(max(1, tasks), "env_id")

    @cached_property
    def envs(self) -> DataFrame:
        return self.tenants.select("env_id")

    def current(self, kind: str) -> DataFrame:
        """The drifted inventory, unfolded from one literal in one scan of the tenants."""
        (keep, changed), extra = DRIFT[kind], EXTRA[kind]
        rows = [{**r, "rule": 0} for r in BASE[kind]] + [{**r, "rule": i} for i, (r, _) in enumerate(extra, 1)]
        unfolded = self.tenants.select("env_id", *_ATTRS, F.inline(literal_rows(rows, ROW_TYPES[kind] + ", rule int")))
        applies = " OR ".join([f"(rule = 0 AND {keep})"] + [f"(rule = {i} AND {w})" for i, (_, w) in enumerate(extra, 1)])
        return unfolded.filter(applies).select("env_id", *[
            F.expr(f"CASE WHEN rule = 0 THEN {changed[c]} ELSE {c} END").alias(c) if c in changed else F.col(c)
            for c in BASE[kind][0]
        ])

    def desired(self, kind: str) -> DataFrame:
        return desired_for(self.envs, kind, BASE[kind])

    @cached_property
    def cur(self) -> Lazy:
        return Lazy(self.current)

    @cached_property
    def des(self) -> Lazy:
        return Lazy(self.desired)

    @cached_property
    def stmt_log(self) -> DataFrame:
        template = F.element_at(
            F.array(*[F.lit(s) for s in STATEMENTS]), (F.col("event_id") % len(STATEMENTS)).cast("int") + 1
        )
        return self.events.select(
            F.col("user_id").alias("env_id"),
            F.dayofmonth("ts").cast("bigint").alias("plan_id"),
            F.hour("ts").cast("bigint").alias("step_no"),
            F.col("event_id").alias("stmt_no"),
            F.replace(template, F.lit("{t}"), F.col("event_type")).alias("sql_text"),
        )
