"""A file catalog, grids and request tables derived from the star-schema tables.

Every row of a source table becomes a row here, so the work of a query on these
tables grows with them. ``ALL`` is a folder above all drives.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafgrid.functions.catalog import FOLDER_MIME
from leafgrid.schemas import FILE
from leafgrid.sources.drives import read_drives

# MIME types given to orders by ``o_orderkey % 7``.
ORDER_MIMES = [
    "application/pdf",
    "application/octet-stream",
    "application/vnd.google-apps.document",
    "application/vnd.google-apps.spreadsheet",
    "application/vnd.google-apps.presentation",
    "application/vnd.google-apps.form",
    "application/vnd.google-apps.shortcut",
]


@lru_cache
def _schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def _records(df: DataFrame, **fields: str) -> DataFrame:
    return df.selectExpr(
        *[
            f"CAST({fields.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in FILE.fields
        ]
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: regions, nations, customers and orders as one tree, parts as
    one flat folder, documents by source and language."""
    folder = f"'{FOLDER_MIME}'"
    person = "named_struct('displayName', {0}, 'emailAddress', {0} || '@example.com')"
    customer = "concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0'))"
    mimes = "element_at(array({}), CAST(o_orderkey % 7 AS INT) + 1)".format(
        ", ".join(f"'{m}'" for m in ORDER_MIMES)
    )
    documents = table(spark, sf_dir, "documents")
    top = spark.range(1)
    parts = [
        _records(
            top, id="'ROOT'", name="'My Drive'", mimeType=folder,
            parents="array('ALL')", trashed="false",
        ),
        _records(
            top, id="'PARTS'", name="'Parts'", mimeType=folder,
            parents="array('ROOT')", trashed="false",
        ),
        _records(
            table(spark, sf_dir, "region"),
            id="concat('D', r_regionkey)", name="r_name", mimeType=folder,
            parents="array('ALL')", trashed="false",
            driveId="concat('D', r_regionkey)",
        ),
        _records(
            table(spark, sf_dir, "nation"),
            id="concat('N', n_nationkey)", name="n_name", mimeType=folder,
            parents="array(concat('D', n_regionkey))", trashed="false",
            driveId="concat('D', n_regionkey)",
        ),
        _records(
            table(spark, sf_dir, "customer"),
            id="concat('C', c_custkey)", name="c_name", mimeType=folder,
            parents="array(concat('N', c_nationkey))", trashed="false",
            driveId="'D'",
            owners=f"array({person.format('c_name')})",
        ),
        _records(
            table(spark, sf_dir, "orders"),
            id="concat('O', o_orderkey)",
            name="if(o_orderkey % 7 < 2, concat(o_orderpriority, '.pdf'), o_orderpriority)",
            mimeType=mimes,
            size="if(o_orderkey % 7 < 2, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING), NULL)",
            webViewLink="if(o_orderkey % 3 = 0, concat('https://docs.google.com/document/d/O', o_orderkey, '/edit?usp=sharing'), NULL)",
            modifiedTime="date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
            owners=f"array({person.format(customer)})",
            sharingUser=f"if(o_orderkey % 5 = 0, {person.format(customer)}, NULL)",
            parents="if(o_orderkey % 13 = 0, array(concat('C', o_custkey), concat('N', o_orderkey % 25)), array(concat('C', o_custkey)))",
            trashed="o_orderkey % 11 = 0",
            sharedWithMeTime="if(o_orderkey % 5 = 0, '2026-01-01T00:00:00Z', NULL)",
            driveId="if(o_orderkey % 5 = 0, NULL, 'D')",
        ),
        _records(
            table(spark, sf_dir, "part"),
            id="concat('P', p_partkey)",
            name="concat(p_name, '.', p_type)",
            mimeType="'text/plain'",
            size="CAST(p_size AS STRING)",
            parents="array('PARTS')",
            trashed="false",
        ),
        _records(
            documents.select("source").distinct(),
            id="concat('S_', source)", name="source", mimeType=folder,
            parents="array('ROOT')", trashed="false",
            sharedWithMeTime="'2026-01-01T00:00:00Z'",
        ),
        _records(
            documents.select("source", "lang").distinct(),
            id="concat('L_', source, '_', lang)", name="lang", mimeType=folder,
            parents="array(concat('S_', source))", trashed="false",
        ),
        _records(
            documents,
            id="concat('T', doc_id)",
            name="concat('doc_', doc_id, '.', lang, '.TXT')",
            mimeType="'text/plain'",
            size="CAST(n_chars AS STRING)",
            webViewLink="concat('https://drive.google.com/file/d/T', doc_id, '/view?usp=x')",
            parents="array(concat('L_', source, '_', lang))",
            trashed="false",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = table(spark, sf_dir, "region").select(
        F.concat(F.lit("D"), "r_regionkey").alias("id"),
        F.col("r_name").alias("name"),
        F.col("r_regionkey").alias("ord"),
    )
    return read_drives(spark.range(1).select(F.lit("ROOT").alias("id")), shared)


def customer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on a first tab below a header, suppliers on a second one."""
    customers = table(spark, sf_dir, "customer").select(
        F.lit("customers").alias("tab"),
        F.lit(0).alias("tab_ord"),
        (F.col("c_custkey") + 2).alias("row_num"),
        F.array(
            F.col("c_custkey").cast("string"),
            "c_name",
            F.col("c_nationkey").cast("string"),
            F.col("c_mktsegment"),
            F.format_string("%.2f", "c_acctbal"),
        ).alias("cells"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("suppliers").alias("tab"),
        F.lit(1).alias("tab_ord"),
        (F.col("s_suppkey") + 1).alias("row_num"),
        F.array(F.col("s_suppkey").cast("string"), "s_name").alias("cells"),
    )
    header = spark.range(1).select(
        F.lit("customers").alias("tab"),
        F.lit(0).alias("tab_ord"),
        F.lit(1).cast("long").alias("row_num"),
        F.array(
            *map(F.lit, ["custkey", "name", "nation", "segment", "acctbal"])
        ).alias("cells"),
    )
    return header.unionByName(customers).unionByName(suppliers)


def supplier_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1).alias("row_num"),
        F.array("s_name", F.col("s_nationkey").cast("string")).alias("cells"),
    )


def path_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file path per order, in changing case, some with unknown names, and a
    folder path per customer."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    homes = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(
        r, F.col("n_regionkey") == F.col("r_regionkey")
    )
    folders = homes.select(
        "c_custkey",
        F.concat_ws("/", "r_name", "n_name", "c_name").alias("folder"),
    )
    k = F.col("o_orderkey")
    name = F.when(k % 7 < 2, F.concat("o_orderpriority", F.lit(".pdf"))).otherwise(
        F.col("o_orderpriority")
    )
    path = F.concat_ws("/", "folder", name)
    of_orders = o.join(folders, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("o"), k).alias("request"),
        F.when(k % 17 == 0, F.concat("folder", F.lit("/none/x")))
        .when(k % 19 == 0, F.concat(F.lit("Nowhere/"), "folder"))
        .when(k % 2 == 0, F.upper(path))
        .otherwise(F.lower(path))
        .alias("path"),
    )
    of_customers = folders.select(
        F.concat(F.lit("c"), "c_custkey").alias("request"),
        F.concat(F.lit("/"), "folder", F.lit("/")).alias("path"),
    )
    return of_orders.unionByName(of_customers)


def shared_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    o = table(spark, sf_dir, "orders")
    k = F.col("doc_id")
    by_document = d.select(
        F.concat(F.lit("d"), k).alias("request"),
        F.when(k % 7 == 0, F.col("source"))
        .when(k % 5 == 0, F.concat_ws("/", F.upper("source"), "lang"))
        .when(k % 3 == 0, F.concat_ws("/", "source", F.lit("nope"), "lang"))
        .otherwise(
            F.concat_ws(
                "/", "source", "lang",
                F.concat(F.lit("DOC_"), k, F.lit("."), "lang", F.lit(".txt")),
            )
        )
        .alias("path"),
    )
    by_order = o.select(
        F.concat(F.lit("o"), "o_orderkey").alias("request"),
        F.concat("o_orderpriority", F.lit("/x")).alias("path"),
    )
    return by_document.unionByName(by_order)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    forms = [
        F.concat(F.lit("https://drive.google.com/file/d/T"), k, F.lit("/view?usp=x")),
        F.concat(F.lit("https://drive.google.com/open?id=T"), k),
        F.concat(F.lit("https://drive.google.com/drive/folders/S_"), "source"),
    ]
    rows = d.select(F.explode(F.array(*forms)).alias("link"))
    return rows.union(table(spark, sf_dir, "pages").select("url"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A url, a drive path or a bare id per document."""
    k = F.col("doc_id")
    place = F.concat_ws(
        "/", F.lit("my drive"), "source", "lang",
        F.concat(F.lit("doc_"), k, F.lit("."), "lang", F.lit(".TXT")),
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), k).alias("request"),
        F.when(k % 4 == 0, F.concat(F.lit("https://docs.google.com/document/d/T"), k, F.lit("/edit")))
        .when(k % 4 == 1, place)
        .when(k % 4 == 2, F.concat(F.lit("T"), k))
        .otherwise(F.lit("https://drive.google.com/drive/my-drive"))
        .alias("source"),
    )


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed update per order, one per nation (many rows match) and one per
    supplier (a key no row has)."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.create_map(
            F.lit("custkey"), F.col("o_custkey").cast("string")
        ).alias("match"),
        F.create_map(F.lit("segment"), F.col("o_orderpriority")).alias("updates"),
    )
    n = table(spark, sf_dir, "nation").select(
        (-F.col("n_nationkey") - 1).cast("long").alias("seq"),
        F.create_map(
            F.lit("nation"), F.col("n_nationkey").cast("string"),
        ).alias("match"),
        F.create_map(F.lit("acctbal"), F.lit("0")).alias("updates"),
    )
    s = table(spark, sf_dir, "supplier").select(
        (-F.col("s_suppkey") - 1000).alias("seq"),
        F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.lit("1")).alias(
            "match"
        ),
        F.create_map(F.lit("acctbal"), F.lit("0")).alias("updates"),
    )
    return o.unionByName(n).unionByName(s)


def mixed_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed update per order of a known customer: six kinds of keys, from one
    column to two, and every reason to refuse one."""
    o = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    k = F.col("o_orderkey")
    text = {
        "custkey": F.col("c_custkey").cast("string"),
        "name": F.col("c_name"),
        "nation": F.col("c_nationkey").cast("string"),
        "segment": F.col("c_mktsegment"),
    }

    def chosen(*maps):
        turn = F.lit(None).cast("map<string,string>")
        for n, pairs in enumerate(maps):
            pairs = F.create_map(*[F.lit(x) if isinstance(x, str) else x for kv in pairs.items() for x in kv])
            turn = F.when(k % len(maps) == n, pairs.cast("map<string,string>")).otherwise(turn)
        return turn

    def on(*columns):
        return {c: text[c] for c in columns}

    seq = k.cast("string")
    match = chosen(
        on("custkey"), on("name", "nation"), on("segment", "custkey"),
        on("nation", "segment"), {"height": "1"}, on("custkey"), on("custkey"),
        on("name"), {**on("custkey"), "name": "nobody"},
    )
    updates = chosen(
        {"segment": F.col("o_orderpriority")}, {"acctbal": seq}, {"segment": seq},
        {"acctbal": "0"}, {"segment": "x"}, {"height": "1"}, {},
        {"acctbal": seq, "nation": "x"}, {"segment": "x"},
    )
    return o.select(k.alias("seq"), match.alias("match"), updates.alias("updates"))
