"""Schema documents (JSON) to inventory frames, and back.

One document describes one environment.  Documents are checked strictly: a
field that is not in the contract, or a required one that is missing or of the
wrong kind, rejects the document.  A permissive JSON read reports neither, so
both are tested by expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from moraine.operators.drift import Inventory
from moraine.operators.inventory import TABLE_KEY, grouped_keys
from moraine.session import staged

# The fields of the document contract, required ones first.
DOCUMENT = (("tables",), ("dialect",))
TABLE = (("name", "columns"), ("indexes", "foreign_keys", "schema", "rls_enabled"))
COLUMN = (("name", "type", "nullable", "is_primary_key"), ("default", "type_metadata", "default_metadata"))
INDEX = (("name", "columns", "unique"), ())
FOREIGN_KEY = (("name", "columns", "referenced_table", "referenced_columns"), ("on_delete", "on_update"))

# What names look like, and the dialects a document may name.
NAME = "^[a-z_][a-z0-9_]*$"
DIALECTS = ("postgres", "sqlite", "")

# The referential actions a document may name.
ACTIONS = ("NO ACTION", "RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT")

_COLUMN_TYPE = "struct<name:string,type:string,nullable:boolean,default:string,is_primary_key:boolean>"
_INDEX_TYPE = "struct<name:string,columns:array<string>,unique:boolean>"
_FK_TYPE = (
    "struct<name:string,columns:array<string>,referenced_table:string,referenced_columns:array<string>,"
    "on_delete:string,on_update:string>"
)


@dataclass(frozen=True)
class SchemaDocs:
    inventory: Inventory
    rejected: DataFrame  # env_id, place, named, problem; one row per problem and place


def read_schema_docs(spark: SparkSession, path: str, one_per_line: bool = False) -> SchemaDocs:
    """Documents below a path, one per file or, for large fleets, one per line.

    The environment is the document's ``env_id`` wrapper field in the line form,
    and the file name without its ending otherwise.
    """
    if one_per_line:
        lines = spark.read.text(path)
        wrapper = F.from_json("value", "struct<env_id:string,document:string>")
        docs = lines.select(wrapper.alias("w")).select("w.env_id", "w.document")
    else:
        files = spark.read.text(path, wholetext=True)
        name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
        docs = files.select(name.alias("env_id"), F.col("value").alias("document"))
    return parse_schema_docs(docs)


def _problem(text: Column, parsed: Column, contract, where: str) -> Column:
    """Array of problems of one JSON object: unknown and missing fields, a name that is none."""
    required, optional = contract
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    unknown = F.array_except(keys, F.array(*[F.lit(k) for k in required + optional]))
    missing = F.array_compact(F.array(*[F.when(parsed[k].isNull(), F.lit(k)) for k in required]))
    named = F.array().cast("array<string>")
    if "name" in required:
        bad = parsed["name"].isNotNull() & ~parsed["name"].rlike(NAME)
        named = F.when(bad, F.array(F.concat(F.lit(f"bad {where} name "), parsed["name"]))).otherwise(named)
    return F.concat(
        named,
        F.transform(unknown, lambda k: F.concat(F.lit(f"unknown {where} field "), k)),
        F.transform(missing, lambda k: F.concat(F.lit(f"missing {where} field "), k)),
    )


def parse_schema_docs(docs: DataFrame) -> SchemaDocs:
    """``env_id, document`` to inventory frames of the accepted documents, and the rejected ones.

    A document is checked within its own row, so nothing is shuffled or joined.
    Problems name their place (``tables[1].columns[0]``) and the names on the way
    (``runs.code``); the same problem in two places is two rows.
    """
    raw = "array<string>"  # nested objects stay JSON text until their fields are tested
    none = F.array().cast(raw)
    table_type = (
        f"struct<name:string,schema:string,rls_enabled:boolean,columns:{raw},indexes:{raw},foreign_keys:{raw}>"
    )

    def objects(items: Column, kind: str, contract, where: str) -> Column:
        """Each item parsed, beside its problems."""
        read = F.transform(F.coalesce(items, none), lambda x: F.struct(x.alias("t"), F.from_json(x, kind).alias("v")))
        return F.transform(read, lambda o: F.struct(
            o["v"].alias("v"), _problem(o["t"], o["v"], contract, where).alias("p")
        ))

    def actions(fk: Column) -> Column:
        named = F.array_compact(F.array(fk["v"]["on_delete"], fk["v"]["on_update"]))
        unknown = F.array_except(named, F.array(*[F.lit(a) for a in ACTIONS]))
        return F.transform(unknown, lambda a: F.concat(F.lit("unknown action "), a))

    top = docs.select("env_id", "document", F.from_json("document", f"struct<tables:{raw},dialect:string>").alias("d"))
    strange = F.coalesce(~F.col("d.dialect").isin(*DIALECTS), F.lit(False))
    dialect = F.when(strange, F.array(F.concat(F.lit("unknown dialect "), F.col("d.dialect")))).otherwise(none)
    # each step is a column of its own, so no text is parsed twice over
    parsed = top.select(
        "env_id", F.concat(_problem(F.col("document"), F.col("d"), DOCUMENT, "document"), dialect).alias("p"),
        objects(F.col("d.tables"), table_type, TABLE, "table").alias("ts"),
    )
    deep = parsed.select("env_id", "p", F.transform("ts", lambda t: F.struct(
        t["v"]["name"].alias("name"), t["v"]["schema"].alias("schema"), t["v"]["rls_enabled"].alias("rls"),
        t["p"].alias("p"),
        objects(t["v"]["columns"], _COLUMN_TYPE, COLUMN, "column").alias("cs"),
        objects(t["v"]["indexes"], _INDEX_TYPE, INDEX, "index").alias("xs"),
        objects(t["v"]["foreign_keys"], _FK_TYPE, FOREIGN_KEY, "foreign key").alias("fs"),
    )).alias("ts"))
    def at(problems: Column, place: Column, *names: Column) -> Column:
        """Each problem with where it is: the path in the document, and the names on it."""
        return F.transform(problems, lambda x: F.struct(place.alias("place"), F.concat_ws(".", *names).alias("named"), x.alias("problem")))

    def within(items: Column, table: Column, i: Column, part: str, more=None) -> Column:
        def of(o: Column, j: Column) -> Column:
            place = F.concat(F.lit("tables["), i, F.lit(f"].{part}["), j, F.lit("]"))
            return at(F.concat(o["p"], more(o)) if more else o["p"], place, table["name"], o["v"]["name"])
        return F.flatten(F.transform(items, of))

    def of_table(t: Column, i: Column) -> Column:
        bare = F.when(F.size(t["cs"]) == 0, F.array(F.lit("table without columns"))).otherwise(none)
        return F.concat(
            at(F.concat(t["p"], bare), F.concat(F.lit("tables["), i, F.lit("]")), t["name"]),
            within(t["cs"], t, i, "columns"), within(t["xs"], t, i, "indexes"), within(t["fs"], t, i, "foreign_keys", actions))

    problems = F.concat(at(F.col("p"), F.lit("document")), F.flatten(F.transform("ts", of_table)))
    # parsed once, however many of the frames below are used; a document with problems keeps only those
    checked = deep.withColumn("problems", problems)
    checked = staged(checked.select("env_id", "problems", F.when(F.size("problems") == 0, F.col("ts")).alias("ts")), "documents")
    rejected = checked.select("env_id", F.inline("problems"))
    good = checked.select("env_id", F.explode("ts").alias("t")).select(
        "env_id",
        F.coalesce("t.schema", F.lit("public")).alias("schema_name"),
        F.col("t.name").alias("table_name"),
        F.coalesce("t.rls", F.lit(False)).alias("rls_enabled"),
        F.col("t.cs.v").alias("cs"), F.col("t.xs.v").alias("xs"), F.col("t.fs.v").alias("fs"),
    )
    cols = good.select(*TABLE_KEY, F.posexplode("cs").alias("i", "c")).select(
        *TABLE_KEY, (F.col("i") + 1).alias("ordinal"), F.col("c.name").alias("column_name"),
        F.col("c.type").alias("type_raw"), F.col("c.nullable").alias("nullable"),
        F.col("c.default").alias("default_raw"), F.col("c.is_primary_key").alias("is_pk"),
    )
    idx = good.select(*TABLE_KEY, F.explode("xs").alias("x")).select(
        *TABLE_KEY, F.col("x.name").alias("index_name"), F.col("x.unique").alias("is_unique"),
        F.posexplode("x.columns").alias("i", "column_name"),
    ).select(*TABLE_KEY, "index_name", (F.col("i") + 1).alias("ordinal"), "column_name", "is_unique")
    fks = good.select(*TABLE_KEY, F.explode("fs").alias("f")).select(
        *TABLE_KEY, F.col("f.name").alias("fk_name"), F.col("f.referenced_table").alias("ref_table"),
        F.col("f.on_delete").alias("on_delete"), F.col("f.on_update").alias("on_update"),
        F.posexplode(F.arrays_zip(F.col("f.columns").alias("a"), F.col("f.referenced_columns").alias("b"))).alias("i", "z"),
    ).select(
        *TABLE_KEY, "fk_name", (F.col("i") + 1).alias("ordinal"), F.col("z.a").alias("column_name"), "ref_table",
        F.col("z.b").alias("ref_column"), "on_delete", "on_update",
    )
    return SchemaDocs(Inventory(good.select(*TABLE_KEY, "rls_enabled"), cols, idx, fks), rejected)


def schema_documents(inv: Inventory) -> DataFrame:
    """``env_id, document`` with all that an inventory holds: schemas, row security, types as they are, column order.

    Lists are columns of a table and tables of an environment.  Each kind of row
    grows with the fleet, so the joins merge, however small a side looks to the planner.
    """
    column = F.struct("ordinal", F.struct(
        F.col("column_name").alias("name"), F.col("type_raw").alias("type"), "nullable",
        F.col("default_raw").alias("default"), F.col("is_pk").alias("is_primary_key")).alias("v"))
    tables = inv.tables.join(
        inv.cols.groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_list(column)).alias("_c")).hint("merge"), TABLE_KEY, "left")
    body = {
        "name": F.col("table_name"), "schema": F.col("schema_name"), "rls_enabled": F.col("rls_enabled"),
        "columns": F.transform("_c", lambda c: c["v"]),
    }
    if inv.idx is not None:
        entry = F.struct(F.col("index_name").alias("name"), F.col("column_names").alias("columns"), F.col("is_unique").alias("unique"))
        tables = tables.join(grouped_keys(inv.idx, "index_name", ["column_name"], ["is_unique"]).groupBy(*TABLE_KEY).agg(
            F.array_sort(F.collect_list(entry)).alias("_x")).hint("merge"), TABLE_KEY, "left")
        body["indexes"] = F.col("_x")
    if inv.fks is not None:
        entry = F.struct(
            F.col("fk_name").alias("name"), F.col("column_names").alias("columns"), F.col("ref_table").alias("referenced_table"),
            F.col("ref_columns").alias("referenced_columns"), "on_delete", "on_update")
        keys = grouped_keys(inv.fks, "fk_name", ["column_name", "ref_column"], ["ref_table", "on_delete", "on_update"])
        tables = tables.join(keys.groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_list(entry)).alias("_f")).hint("merge"), TABLE_KEY, "left")
        body["foreign_keys"] = F.col("_f")
    text = F.to_json(F.struct(*[c.alias(n) for n, c in body.items()]))
    sorted_tables = F.array_sort(F.collect_list(F.struct("schema_name", "table_name", text.alias("text"))))
    return tables.groupBy("env_id").agg(sorted_tables.alias("_t")).select("env_id", F.concat(
        F.lit('{"tables":['), F.array_join(F.transform("_t", lambda t: t["text"]), ","), F.lit("]}")).alias("document"))


def write_inventory(inv: Inventory, path: str, buckets: int = 64, files: int = 4) -> None:
    """Each environment's schema as a JSON document, one per line, in hashed folders.

    Folders are hash buckets rather than environments, so a fleet of millions
    does not become millions of folders; each gets about ``files`` files.  Read
    back, the documents give the same inventory, columns numbered from one.
    """
    docs = schema_documents(inv)
    lines = docs.select(
        F.pmod(F.xxhash64("env_id"), F.lit(buckets)).alias("env_bucket"),
        F.to_json(F.struct(F.col("env_id").cast("string").alias("env_id"), "document")).alias("value"),
    )
    spread = F.pmod(F.hash("value"), F.lit(files))
    lines.repartition("env_bucket", spread).write.mode("overwrite").partitionBy("env_bucket").text(path)
