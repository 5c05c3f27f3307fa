"""The registered queries, each on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid import scratch
from leafgrid.functions.catalog import (
    file_type,
    format_bytes,
    is_malformed_time,
    modified_date,
    owner_email,
    shared_by,
)
from leafgrid.operators import children, grid, keyed, links, lookup, resolve
from leafgrid.functions.names import safe_filename
from leafgrid.operators import targets, transfer, walk
from leafgrid.plans import browse, derived
from leafgrid.plans.download import plan_download
from leafgrid.sources import drives, edges, grids, listings, pages
from leafgrid.sources.rejects import split_rejects
from leafgrid.sources.snapshot import read_snapshot
from leafgrid.streaming.pages import stream_file_pages, upsert_new_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EVERYTHING = "ALL"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _text(column: str, sep: str = "/"):
    return F.array_join(column, sep).alias(column)


def _grid_text(df: DataFrame) -> DataFrame:
    return df.select("tab", "row_num", _text("cells", "|"))


# -- sources and sinks --


@query
def q_file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = derived.table(spark, sf_dir, "orders")
    record = F.struct(
        F.concat(F.lit("O"), "o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("text/plain")).alias("mimeType"),
        F.when(F.col("o_orderkey") % 13 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(F.col("o_orderkey") % 17 == 0, F.date_format("o_orderdate", "yyyy-99-dd'T'HH"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .alias("modifiedTime"),
        F.array(
            F.struct(F.concat("o_orderstatus", F.lit("@example.com")).alias("emailAddress"))
        ).alias("owners"),
        (F.col("o_orderkey") % 11 == 0).alias("trashed"),
    )
    # A page holds a hundred records; a page without any follows every tenth.
    page = orders.groupBy(F.floor(F.col("o_orderkey") / 100).alias("page")).agg(
        F.collect_list(record).alias("files")
    )
    filled, empty = F.to_json(F.struct("files")), F.lit('{"nextPageToken": "t"}')
    text = page.select(
        F.explode(
            F.when(F.col("page") % 10 == 9, F.array(filled, empty)).otherwise(F.array(filled))
        ).alias("json")
    )
    return pages.parse_pages(text, "json").select(
        "id",
        "name",
        "mimeType",
        file_type().alias("file_type"),
        modified_date().alias("modified"),
        is_malformed_time().alias("malformed"),
        owner_email().alias("owner"),
        shared_by().alias("shared_by"),
        "trashed",
    )


@query
def q_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.drives(spark, sf_dir)


@query
def q_drive_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with a drive for each customer, saved over a shorter one and loaded."""
    shared = derived.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_custkey").alias("ord"),
    )
    root = spark.range(1).select(F.lit("ROOT").alias("id"))
    path = scratch.new_path(spark, "drives")
    for part in (shared.filter("ord % 2 = 0"), shared):
        drives.save_drives(drives.read_drives(root, part), path)
    return drives.load_drives(spark, path)


def _write_drop(records: DataFrame, path: str) -> None:
    """A drop of page files: a hundred records a page, one page a line."""
    record = F.struct("id", "name", "modifiedTime")
    page = records.groupBy(F.floor(F.col("n") / 100)).agg(F.collect_list(record).alias("files"))
    page.select(F.to_json(F.struct("files"))).write.mode("append").text(path)


@query
def q_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a first drop; newer, older and new records in a second; then the
    first drop once more. Each is merged by the stream that read the one before."""
    orders = derived.table(spark, sf_dir, "orders")
    time = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey")
    first = orders.select(
        k.alias("n"),
        F.concat(F.lit("O"), k).alias("id"),
        F.col("o_orderpriority").alias("name"),
        time.alias("modifiedTime"),
    )
    changed = orders.filter(k % 3 == 0).select(
        k.alias("n"),
        F.concat(F.lit("O"), k).alias("id"),
        F.concat("o_orderpriority", F.lit(" new")).alias("name"),
        F.when(k % 2 == 0, F.concat(time, F.lit("Z")))
        .when(k % 5 != 0, F.lit("1970-01-01T00:00:00"))
        .alias("modifiedTime"),
    )
    added = derived.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("n"),
        F.concat(F.lit("P"), "p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("modifiedTime"),
    )
    drops, kept, mark = (scratch.new_path(spark, n) for n in ("drops", "snapshot", "mark"))
    for drop in (first, changed.unionByName(added), first):
        _write_drop(drop, drops)
        upsert_new_pages(stream_file_pages(spark, drops), kept, mark).awaitTermination()
    return read_snapshot(spark, kept).select("id", "name", "modifiedTime")


@query
def q_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    records = derived.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"),
        F.when(k % 13 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(k % 17 == 0, F.lit(""))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .alias("modifiedTime"),
        F.when(k % 11 == 0, F.concat(k.cast("string"), F.lit(" kB")))
        .when(k % 19 == 0, F.lit("1.5"))
        .when(k % 23 == 0, F.concat(F.lit("9"), F.repeat(F.lit("0"), 19)))
        .when(k % 2 == 0, (k * 7).cast("string"))
        .alias("size"),
    )
    readable, rejects = split_rejects(records)
    nothing = F.lit(None).cast("string")
    return readable.select(
        "id", nothing.alias("field"), nothing.alias("value"), nothing.alias("reason")
    ).unionByName(rejects)


@query
def q_grid_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derived.table(spark, sf_dir, "part")
    quoted = F.concat(F.lit('"'), "p_name", F.lit(', ""x"""'))
    lines = part.select(
        (F.col("p_partkey") + 1).alias("row_num"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit(""))
        .when(F.col("p_partkey") % 4 == 0, F.concat_ws(",", "p_brand", quoted, F.lit("")))
        .otherwise(F.concat_ws(",", F.col("p_partkey").cast("string"), "p_type"))
        .alias("line"),
    )
    return _grid_text(grids.parse_lines(lines, "line", "row_num"))


@query
def q_grid_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a delimited file with line breaks and quotes inside cells and with
    blank lines, written and read back in splits."""
    k = F.col("p_partkey")
    lines = derived.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(k % 9 == 0, F.lit(""))
        .when(k % 4 == 0, F.concat(k.cast("string"), F.lit(',"'), "p_name", F.lit('\n\n""x"", y"\r')))
        .when(k % 4 == 1, F.concat(F.lit('"a\r\n'), "p_brand", F.lit('"",\n",b"c,"d"')))
        .otherwise(F.concat_ws(",", k.cast("string"), "p_type", F.lit("")))
        .alias("line"),
    )
    lines = lines.repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey")
    path = scratch.new_path(spark, "quoted")
    lines.select("line").write.text(path)
    return _grid_text(grids.read_grid(spark, path))


@query
def q_grid_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derived.table(spark, sf_dir, "part")
    cells = part.select(
        (F.col("p_partkey") + 1).alias("row_num"),
        F.when(F.col("p_partkey") % 9 == 0, F.array().cast("array<string>"))
        .when(F.col("p_partkey") % 5 == 0, F.array(F.lit("")))
        .otherwise(F.array("p_brand", F.concat("p_name", F.lit(', "x"')), F.lit("")))
        .alias("cells"),
    )
    return grids.rendered_lines(cells)


@query
def q_listing_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.listing_csv(
        walk.listing(derived.files(spark, sf_dir), EVERYTHING)
    )


@query
def q_folder_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = walk.listing(derived.files(spark, sf_dir), EVERYTHING)
    return listings.folder_map(listing).select("line")


@query
def q_save_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One walk saved to a folder map and a CSV file, both read back."""
    rows = walk.listing(derived.files(spark, sf_dir), EVERYTHING)
    home = scratch.new_path(spark, "saved")
    listings.save_listing(rows, [f"{home}/map.md", f"{home}/rows.csv"])
    cells = [f"c{i} STRING" for i in range(7)]
    table = spark.read.schema(",".join(cells)).csv(f"{home}/rows.csv", escape='"')
    return (
        spark.read.text(f"{home}/map.md")
        .select(F.lit("map").alias("sink"), F.col("value").alias("line"))
        .unionByName(
            table.select(
                F.lit("csv").alias("sink"),
                F.array_join(F.array(*table.columns), "|", "").alias("line"),
            )
        )
    )


@query
def q_list_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.list_path(
        derived.files(spark, sf_dir), derived.drives(spark, sf_dir), "/asia/nation_7/", None
    ).drop("sort_key")


@query
def q_list_shared_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.list_shared(
        derived.files(spark, sf_dir), "SRC1", None
    ).drop("sort_key")


# -- tree and paths --


def _laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "edges")
    edges.write_edges(derived.files(spark, sf_dir), path)
    return edges.read_edges(spark, path)


@query
def q_children_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As q_children, from row groups of the edge table."""
    found = children.list_children(_laid_out(spark, sf_dir), "PARTS")
    return found.select("id", "name", "mimeType")


@query
def q_walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_text(walk.walk_tree(_laid_out(spark, sf_dir), EVERYTHING))


@query
def q_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.files(spark, sf_dir)
    return children.list_children(files, "PARTS").select("id", "name", "mimeType")


@query
def q_children_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.files(spark, sf_dir)
    edges = children.child_edges(children.in_corpora(files, "user"))
    return edges.select("parent", "id", "name")


@query
def q_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children.shared_with_me(derived.files(spark, sf_dir)).select(
        "id", "name", shared_by().alias("shared_by")
    )


@query
def q_shared_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.files(spark, sf_dir)
    return children.shared_with_me(files, "1-urgent").select("id", "name")


@query
def q_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = derived.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("O"), F.col("l_orderkey") * 2).alias("id")
    )
    return children.get_metadata(derived.files(spark, sf_dir), ids)


def _walk_text(df: DataFrame) -> DataFrame:
    return df.select("id", "name", _text("ancestors"), "depth", "descended")


@query
def q_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_text(walk.walk_tree(derived.files(spark, sf_dir), EVERYTHING))


@query
def q_walk_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_text(walk.walk_tree(derived.files(spark, sf_dir), EVERYTHING, 2))


@query
def q_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = walk.listing(derived.files(spark, sf_dir), EVERYTHING)
    return listing.drop("sort_key")


@query
def q_shared_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = children.shared_with_me(derived.files(spark, sf_dir))
    return walk.shared_listing(shared).drop("sort_key")


@query
def q_find_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = derived.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.element_at(
            F.array(*map(F.lit, ["asia", "MY DRIVE", "Europe", "none", "africa"])),
            (F.col("c_custkey") % 5 + 1).cast("int"),
        ).alias("name"),
    )
    return lookup.find_drive(names, derived.drives(spark, sf_dir))


@query
def q_drive_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = lookup.match_drive_prefix(
        derived.path_requests(spark, sf_dir), derived.drives(spark, sf_dir)
    )
    return matched.select("path", "drive_id", "drive_name", _text("rest"))


@query
def q_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_paths(
        derived.path_requests(spark, sf_dir),
        derived.files(spark, sf_dir),
        derived.drives(spark, sf_dir),
        allow_files=True,
    ).select("request", "path", "id", "status", "segment", "kind", "at_folder")


@query
def q_resolve_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_paths(
        derived.path_requests(spark, sf_dir),
        derived.files(spark, sf_dir),
        derived.drives(spark, sf_dir),
    ).select("request", "path", "id", "status", "segment", "kind", "at_folder")


@query
def q_resolve_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_shared_paths(
        derived.shared_requests(spark, sf_dir),
        derived.files(spark, sf_dir),
        allow_files=True,
    ).select("request", "path", "id", "status", "segment", "kind")


@query
def q_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.ambiguous_names(derived.files(spark, sf_dir))


@query
def q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = derived.sources(spark, sf_dir)
    routed = None
    for policy in ("export", "download", "sheets"):
        rows = resolve.route_sources(sources, policy).select(
            F.lit(policy).alias("policy"), "request", "source", "route", "id"
        )
        routed = rows if routed is None else routed.unionByName(rows)
    return routed


@query
def q_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_sources(
        derived.sources(spark, sf_dir),
        "sheets",
        derived.files(spark, sf_dir),
        derived.drives(spark, sf_dir),
    )


@query
def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_inventory(derived.links(spark, sf_dir))


# -- transfer planning --


@query
def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.classify(derived.files(spark, sf_dir)).select(
        "id", file_type().alias("file_type"), "disposition"
    )


@query
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = walk.walk_tree(derived.files(spark, sf_dir), EVERYTHING)
    return transfer.summarize(rows).withColumn(
        "size_text", format_bytes(F.col("binary_bytes"))
    )


@query
def q_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = derived.table(spark, sf_dir, "orders")
    # Whole and quarter units, so that exact ties come up in every unit. A BIGINT
    # holds these products only for keys below 2**20.
    unit = F.pow(F.lit(2), F.col("o_orderkey") % 44).cast("long")
    bytes_ = F.col("o_orderkey").cast("decimal(19,0)") * unit
    return orders.select("o_orderkey", format_bytes(bytes_).alias("size_text"))


def _manifest(spark: SparkSession, sf_dir: str, out_dir: str) -> DataFrame:
    rows = walk.walk_tree(derived.files(spark, sf_dir), EVERYTHING)
    return transfer.transfer_manifest(rows, out_dir)


@query
def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir, "out/").select("id", "action", "dir", "base")


@query
def q_manifest_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders at the end of the walk are skipped, not made."""
    rows = walk.walk_tree(derived.files(spark, sf_dir), EVERYTHING, 2)
    return transfer.transfer_manifest(rows, "out").select("id", "action", "dir", "base")


@query
def q_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    odd = (
        F.when(k % 7 == 0, F.concat(F.lit(" ../"), "p_name", F.lit("\\"), "p_brand", F.lit("\t")))
        .when(k % 7 == 1, F.concat("p_name", F.lit("\x00"), "p_type", F.lit("\n\n")))
        .when(k % 7 == 2, F.lit(" .. "))
        .when(k % 7 == 3, F.lit("."))
        .when(k % 7 == 4, F.lit(" \t "))
        .when(k % 7 == 5, F.concat(F.lit("."), "p_name"))
        .otherwise(F.col("p_name"))
    )
    part = derived.table(spark, sf_dir, "part")
    return part.select("p_partkey", safe_filename(odd).alias("safe"))


@query
def q_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = scratch.store(_manifest(spark, sf_dir, "."), "manifest")
    return targets.allocate_targets(manifest).select("id", "action", "dir", "target")


@query
def q_targets_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered names that meet real ones: parts by turns under their name and
    as a copy 1 or 2 of it, with the plain names already on disk."""
    turn = F.substring("id", 2, 20).try_cast("long") % 3
    copy = F.concat(F.lit(" ("), turn.cast("string"), F.lit(")$1"))
    manifest = _manifest(spark, sf_dir, ".").withColumn(
        "base",
        F.when(
            F.col("id").startswith("P") & (turn > 0),
            F.regexp_replace("base", F.lit(r"(\.[A-Z])"), copy),
        ).otherwise(F.col("base")),
    )
    return targets.allocate_targets(
        scratch.store(manifest, "manifest"), _present(spark, sf_dir)
    ).select("id", "target")


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths on disk: a file for every tenth customer folder, some part names."""
    homes = (
        derived.table(spark, sf_dir, "customer")
        .join(
            derived.table(spark, sf_dir, "nation"),
            F.col("c_nationkey") == F.col("n_nationkey"),
        )
        .join(
            derived.table(spark, sf_dir, "region"),
            F.col("n_regionkey") == F.col("r_regionkey"),
        )
        .filter(F.col("c_custkey") % 10 == 0)
    )
    folders = homes.select(
        F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"),
        F.lit(False).alias("is_dir"),
    )
    parts = derived.table(spark, sf_dir, "part").select(
        F.concat(F.lit("My Drive/Parts/"), "p_name", F.lit("."), "p_type"),
        F.lit(False),
    )
    return folders.union(parts.distinct())


@query
def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = scratch.store(_manifest(spark, sf_dir, "."), "manifest")
    present = scratch.store(_present(spark, sf_dir), "present")
    placed = scratch.store(targets.allocate_targets(manifest, present), "targets")
    return transfer.path_conflicts(placed, present)


@query
def q_export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    extension = F.element_at(
        F.array(*map(F.lit, [".csv", ".DOCX", ".pptx", ".Xlsx", ".pdf", ""])),
        (k % 6 + 1).cast("int"),
    )
    requests = derived.sources(spark, sf_dir).join(
        derived.table(spark, sf_dir, "documents").select(
            F.concat(F.lit("s"), k).alias("request"),
            F.concat(F.lit("out.d/"), "lang", extension).alias("output"),
        ),
        "request",
    )
    return transfer.export_plan(requests)


@query
def q_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_download(derived.files(spark, sf_dir), EVERYTHING, "out")
    return plan.manifest.groupBy("action").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count("target").alias("files"),
        F.count_distinct("target").alias("paths"),
    )


# -- grids --


@query
def q_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tabs(derived.customer_grid(spark, sf_dir))


@query
def q_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_text(
        grid.read_range(derived.customer_grid(spark, sf_dir), "customers!B:D")
    )


@query
def q_update_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = grid.update_range(
        derived.customer_grid(spark, sf_dir),
        "customers!E3",
        derived.supplier_values(spark, sf_dir),
    )
    return _grid_text(written.grid)


@query
def q_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = grid.append_rows(
        derived.customer_grid(spark, sf_dir),
        "customers!A1",
        derived.supplier_values(spark, sf_dir),
    )
    return _grid_text(written.grid)


@query
def q_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared, _ = grid.clear_range(
        derived.customer_grid(spark, sf_dir), "customers!D2:E"
    )
    return _grid_text(cleared)


@query
def q_apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = derived.table(spark, sf_dir, "orders").select(
        F.lit("customers").alias("tab"),
        (F.col("o_custkey") + 2).alias("row_num"),
        F.when(F.col("o_orderkey") % 2 == 0, 3).otherwise(6).alias("col_idx"),
        F.col("o_orderpriority").alias("value"),
        F.col("o_orderkey").alias("seq"),
    )
    changed, _ = grid.apply_edits(derived.customer_grid(spark, sf_dir), edits)
    return _grid_text(changed)


@query
def q_range_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits given as A1 ranges; even orders write four cells, odd ones one far out."""
    near = F.array(
        F.array("o_orderpriority", "o_orderstatus"),
        F.array(F.lower("o_orderpriority"), F.col("o_orderstatus")),
    )
    row, even = F.col("o_custkey"), F.col("o_orderkey") % 2 == 0
    writes = derived.table(spark, sf_dir, "orders").select(
        F.when(even, F.concat(F.lit("'customers'!c"), row + 1, F.lit(":D"), row + 2))
        .otherwise(F.concat(F.lit("customers!AB"), row + 2))
        .alias("range"),
        F.when(even, near).otherwise(F.array(F.array("o_orderstatus"))).alias("values"),
        F.col("o_orderkey").alias("seq"),
    )
    grid_ = derived.customer_grid(spark, sf_dir)
    changed, _ = grid.apply_edits(grid_, grid.parse_edits(writes))
    return _grid_text(changed)


@query
def q_parse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = grid.parse_cells(derived.customer_grid(spark, sf_dir))
    return typed.withColumn("as_date", F.col("as_date").cast("string"))


@query
def q_find_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.find_rows(
        derived.customer_grid(spark, sf_dir), {"segment": "MACHINERY", "nation": "7"}
    )


@query
def q_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.to_table(derived.customer_grid(spark, sf_dir))


def _set(spark: SparkSession, sf_dir: str) -> keyed.KeyedUpdate:
    return keyed.set_by_match(
        derived.customer_grid(spark, sf_dir),
        {"segment": "MACHINERY"},
        {"acctbal": "0.00", "segment": "TOOLS"},
        allow_multiple=True,
    )


@query
def q_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_text(_set(spark, sf_dir).grid)


@query
def q_set_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set(spark, sf_dir).edits


def _set_batch(spark: SparkSession, sf_dir: str) -> keyed.BatchUpdate:
    return keyed.set_by_keys(
        derived.customer_grid(spark, sf_dir), derived.instructions(spark, sf_dir)
    )


@query
def q_set_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_batch(spark, sf_dir).results


@query
def q_set_batch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_text(_set_batch(spark, sf_dir).grid)


@query
def q_set_batch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_batch(spark, sf_dir).edits


def _set_kinds(spark: SparkSession, sf_dir: str) -> keyed.BatchUpdate:
    return keyed.set_by_keys(
        derived.customer_grid(spark, sf_dir), derived.mixed_instructions(spark, sf_dir)
    )


@query
def q_set_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_kinds(spark, sf_dir).results


@query
def q_set_kinds_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_text(_set_kinds(spark, sf_dir).grid)


@query
def q_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    texts = derived.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k % 10 == 3, F.array(F.lit("noequals"), F.lit("a=1")))
        .when(k % 10 == 7, F.array(F.lit(" =v")))
        .otherwise(
            F.array(
                F.concat(F.lit(" name ="), "c_name"),
                F.concat(F.lit("key=x="), k),
                F.concat(F.lit("key="), k, F.lit("=y ")),
            )
        )
        .alias("pairs"),
    )
    parsed = keyed.parse_pairs(texts, "pairs", "match")
    return parsed.select(
        "c_custkey",
        F.col("match")["name"].alias("name"),
        F.col("match")["key"].alias("key"),
        F.size("match").alias("n"),
        F.col("match_error").alias("error"),
    )
