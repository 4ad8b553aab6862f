"""Value tables for type names, defaults, conversions and statements."""

import pytest
from pyspark.sql import functions as F

from moraine.functions import statements as st
from moraine.functions import typenames as tn


def evaluate(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_type(spark):
    cases = {
        "int2": "smallint", "pg_catalog.int4": "integer", "int8": "bigint", "bool": "boolean", "BOOL": "boolean",
        "pg_catalog.varchar(255)": "varchar(255)", "bpchar(3)": "char(3)", "float4": "real",
        "float8": "double precision", "numeric(10, 2)": "numeric(10,2)", "text[]": "text[]", "int4[][]": "integer[]",
        "timestamp": "timestamp without time zone", "timestamptz": "timestamp with time zone",
        "serial8": "bigserial", "my_enum": "my_enum", "other.mood": "other.mood", "integer": "integer",
        "double precision": "double precision", "time": "time without time zone", "timetz": "time with time zone",
    }
    assert evaluate(spark, list(cases), tn.normalize_type) == list(cases.values())


def test_normalize_default(spark):
    cases = {
        "'{}'::jsonb": "'{}'", "now()": "now()", "'a::b'": "'a::b'", "'x'::character varying": "'x'",
        "(now() at time zone 'utc'::text)": "(now() at time zone 'utc'::text)", "::text": "::text",
        "'a'::text::varchar": "'a'::text", "0": "0", "nextval('t_id_seq'::regclass)": "nextval('t_id_seq'::regclass)",
        "f('(')::text": "f('(')", "(a::int)::text": "(a::int)",
    }
    assert evaluate(spark, list(cases), tn.normalize_default) == list(cases.values())


def test_is_widening(spark):
    cases = [
        ("smallint", "bigint", True), ("integer", "numeric", True), ("bigint", "integer", False), ("text", "varchar", False),
        ("varchar(100)", "text", True), ("varchar(100)", "varchar(50)", True), ("text", "text[]", True),
        ("numeric(10,4)", "numeric(10,2)", True), ("real", "double precision", True), ("date", "timestamptz", True),
        ("timestamptz", "timestamp", False), ("double precision", "real", False), ("char(3)", "varchar(9)", True),
        ("Integer", "BIGINT", True), ("int4", "bigint", False),
        ("timestamp without time zone", "timestamp with time zone", True), ("date", "timestamp without time zone", True),
        ("character varying", "text", True), ("timestamp with time zone", "timestamp without time zone", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, want boolean")
    wrong = df.filter(tn.is_widening(F.col("a"), F.col("b")) != F.col("want")).collect()
    assert wrong == []


@pytest.mark.parametrize("text,want", [
    ("42", "42"), ("-7", "-7"), ("0.5", "0.5"), ("'it''s'", "it's"), ("TRUE", "true"), ("NULL", None),
    ("'x'::text", "x"), ("lower('ABC')", "abc"), ("concat('a', upper('b'))", "aB"),
    ("CURRENT_TIMESTAMP(3)", "2024-06-01 00:00:00"), ("now()", "2024-06-01 00:00:00"), ("CURRENT_DATE", "2024-06-01"),
    ("LOCALTIME", "00:00:00"),
])
def test_default_column(spark, text, want):
    now = F.expr("timestamp_ntz'2024-06-01 00:00:00'")
    assert spark.range(1).select(tn.default_column(text, now).cast("string").alias("v")).first().v == want


@pytest.mark.parametrize("text", ["1 + 1", "drop_everything()", "UNDEFINED_EXPRESSION", "(SELECT 1)", ""])
def test_unknown_default_raises(spark, text):
    with pytest.raises(ValueError):
        tn.default_column(text)


@pytest.mark.parametrize("name,want", [
    ("int4", "int"), ("varchar(20)", "string"), ("numeric(10,2)", "decimal(10,2)"), ("numeric", "decimal(38,18)"),
    ("text[]", "array<string>"), ("timestamptz", "timestamp"), ("timestamp", "timestamp_ntz"), ("jsonb", "string"),
    ("uuid", "string"), ("double precision", "double"), ("serial", "int"),
])
def test_spark_type(name, want):
    assert tn.spark_type(name) == want


def test_unsupported_type_raises():
    with pytest.raises(ValueError):
        tn.spark_type("tsvector")


LOCKS = {
    "": "ACCESS SHARE", "   ": "ACCESS SHARE", "CREATE INDEX i ON t (a)": "SHARE",
    "CREATE UNIQUE INDEX i ON t (a)": "SHARE", "create index concurrently i on t (a)": "SHARE UPDATE EXCLUSIVE",
    "ALTER TABLE t ADD COLUMN a int": "ACCESS EXCLUSIVE", "ALTER TABLE t DROP COLUMN a": "ACCESS EXCLUSIVE",
    "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0)": "ACCESS EXCLUSIVE",
    "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID": "ACCESS EXCLUSIVE",
    "ALTER TABLE t VALIDATE CONSTRAINT c": "SHARE UPDATE EXCLUSIVE", "DROP TABLE t": "ACCESS EXCLUSIVE",
    "DROP INDEX i": "ACCESS EXCLUSIVE", "TRUNCATE t": "ACCESS EXCLUSIVE", "CREATE TABLE t (a int)": "ACCESS SHARE",
    "INSERT INTO t VALUES (1)": "ROW EXCLUSIVE", "UPDATE t SET a = 1": "ROW EXCLUSIVE", "DELETE FROM t": "ROW EXCLUSIVE",
    "SELECT * FROM t": "ACCESS SHARE", "GRANT ALL ON t TO x": "ACCESS EXCLUSIVE", "\n\tselect 1": "ACCESS SHARE",
}


def test_lock_mode(spark):
    got = evaluate(spark, list(LOCKS), lambda c: st.lock_name(st.lock_level(st.normalized(c))))
    assert got == list(LOCKS.values())


def test_lock_effects(spark):
    df = spark.range(8).select(
        F.col("id").cast("int").alias("l"), st.blocks_reads(F.col("id").cast("int")).alias("r"),
        st.blocks_writes(F.col("id").cast("int")).alias("w"),
        st.impact_name(st.impact_level(F.col("id").cast("int"))).alias("i"),
    ).orderBy("l").collect()
    assert [x.r for x in df] == [False] * 7 + [True]
    assert [x.w for x in df] == [False] * 4 + [True] * 4
    assert [x.i for x in df] == ["NONE", "NONE", "NONE", "LOW", "MEDIUM", "HIGH", "HIGH", "HIGH"]


def test_rewrites(spark):
    cases = {
        "CREATE INDEX i ON t (a)": ["CREATE INDEX CONCURRENTLY i ON t (a)"],
        "create unique index i on t (a)": ["create unique index CONCURRENTLY i on t (a)"],
        "CREATE INDEX CONCURRENTLY i ON t (a)": None,
        "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0)": [
            "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID", "ALTER TABLE t VALIDATE CONSTRAINT c"],
        "ALTER TABLE t ADD CONSTRAINT c UNIQUE (a);": [
            "ALTER TABLE t ADD CONSTRAINT c UNIQUE (a) NOT VALID;", "ALTER TABLE t VALIDATE CONSTRAINT c"],
        "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID": None,
        "ALTER TABLE t ALTER COLUMN a TYPE bigint": [],
        "ALTER TABLE t ADD COLUMN a int": None, "": None,
    }
    got = evaluate(spark, list(cases), lambda c: st.rewritten(c, st.rewrite_kind(c, st.normalized(c))))
    assert got == list(cases.values())


def test_constraint_names(spark):
    cases = {
        "ALTER TABLE t ADD CONSTRAINT c CHECK (a)": "c", "ALTER TABLE t ADD CONSTRAINT CHECK (a)": "t_check",
        "ALTER TABLE t ADD CONSTRAINT UNIQUE (a)": "t_unique", "ALTER TABLE t ADD FOREIGN KEY (a) REFERENCES b": "t_fkey",
        "ALTER TABLE t ADD COLUMN a int": "constraint_name", "SELECT 1": "constraint_name",
    }
    assert evaluate(spark, list(cases), st.constraint_name) == list(cases.values())


def test_dangerous(spark):
    cases = {
        "DROP TABLE t CASCADE": "dangerous_drop_table", "truncate table a, b": "dangerous_truncate",
        "DELETE FROM t": "dangerous_delete_all", "DELETE FROM t WHERE a = 1": None,
        "DELETE FROM t -- WHERE a = 1": "dangerous_delete_all", "DELETE FROM t /* WHERE */": "dangerous_delete_all",
        "DELETE FROM t WHERE b = 'x'": None, "ALTER TABLE t DROP COLUMN a": "dangerous_drop_column",
        "ALTER TABLE t DROP a": "dangerous_drop_column", "ALTER TABLE t DROP CONSTRAINT c": None,
        "ALTER TABLE t ALTER COLUMN a DROP NOT NULL": None, "ALTER TABLE t ALTER a DROP DEFAULT": None,
        "INSERT INTO t VALUES ('DROP TABLE x')": None, "/* old */ DROP TABLE t": "dangerous_drop_table",
        "SELECT 'it''s', 'TRUNCATE t'": None, "DROP INDEX i": None,
    }
    assert evaluate(spark, list(cases), st.dangerous_code) == list(cases.values())


def test_non_declarative(spark):
    cases = {
        "CREATE TABLE IF NOT EXISTS t (a int)": "non_declarative_if_not_exists", "CREATE TABLE t (a int)": None,
        "CREATE UNIQUE INDEX IF NOT EXISTS i ON t (a)": "non_declarative_if_not_exists",
        "BEGIN": "non_declarative_transaction", "START TRANSACTION": "non_declarative_transaction",
        "ROLLBACK;": "non_declarative_transaction", "CREATE OR REPLACE VIEW v AS SELECT 1": "non_declarative_or_replace",
        "CREATE VIEW v AS SELECT 1": None, "COMMENT ON TABLE t IS 'BEGIN'": None,
    }
    assert evaluate(spark, list(cases), st.non_declarative_code) == list(cases.values())


def test_marks_in_comments_and_strings_open_nothing(spark):
    from moraine.operators import audit as au

    cases = {
        "DELETE FROM t -- don't\nWHERE id = 1": [], "-- don't\nDROP TABLE t": ["dangerous_drop_table"],
        "DELETE FROM t WHERE note = '-- no'": [], "DELETE FROM t /* it's WHERE */": ["dangerous_delete_all"],
        "ALTER TABLE t DROP COLUMN a, DROP COLUMN b": ["dangerous_drop_column"] * 2,
        "ALTER TABLE t DROP COLUMN a, ALTER COLUMN b DROP NOT NULL": ["dangerous_drop_column"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "stmt_no long, sql_text string")
    got = {}
    for r in au.flag_dangerous_statements(df).collect():
        got.setdefault(r.sql_text, []).append(r.code)
    assert got == {k: v for k, v in cases.items() if v}


def test_rescale_holds_long_integers(spark):
    from moraine.operators import probes as pr

    df = spark.createDataFrame([("1" * 25 + ".15",), ("2.00",)], "v string").selectExpr("cast(v AS decimal(38,2)) AS v")
    got = [tuple(r) for r in pr.decimal_rescale(df, "v", 30, 1).collect()]
    assert [(str(v), changed) for v, changed in got] == [("1" * 25 + ".2", True), ("2.0", False)]
