"""Name paths to ids, for a whole table of paths at once.

Paths share their beginnings, so names are looked up for distinct path prefixes.
A round takes the next ``LEVELS`` names of every open path. It resolves each
distinct prefix of them once, level by level: a prefix takes the folder that the
prefix above it has led to, and is joined to the names of the catalog. At the end
of a round the paths are joined once to the longest of their prefixes. Paths that
have failed or ended are in no later round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrid import scratch
from leafgrid.functions.catalog import extract_id, is_folder, is_url, owner_email
from leafgrid.operators.children import child_edges, in_corpora, shared_items
from leafgrid.operators.lookup import path_parts, with_drive
from leafgrid.skew import sized

# Names of a path that one round looks up.
LEVELS = 4
# Stands for the names behind the end of a path; no segment holds a slash.
ENDED = "/"


def name_index(
    files: DataFrame, corpora: str = "allDrives", wanted: DataFrame | None = None
) -> DataFrame:
    """Live children counted by parent and case-insensitive name.

    Counts are combined map-side, so a name repeated millions of times in one
    folder becomes one row. ``wanted`` (column ``lname``) keeps only those names:
    by a broadcast if they measure small enough, else by a sort-merge semi-join,
    which can split a name of very many files.
    """
    edges = child_edges(in_corpora(files, corpora)).select(
        "parent", F.lower("name").alias("lname"), "id", is_folder().alias("folder")
    )
    if wanted is not None:
        size = F.sum(F.octet_length("lname") + 16)
        wanted, seen = scratch.measure(wanted, "wanted", size=size)
        edges = edges.join(sized(wanted, seen["size"]), "lname", "left_semi")
    return edges.groupBy("parent", "lname").agg(
        F.count_if("folder").alias("folders"),
        F.count(F.lit(1)).alias("items"),
        F.min(F.when(F.col("folder"), F.col("id"))).alias("folder_child"),
        F.min("id").alias("item_child"),
    )


def resolve_paths(
    requests: DataFrame,
    files: DataFrame,
    drives: DataFrame,
    allow_files: bool = False,
) -> DataFrame:
    """Adds the id each ``path`` leads to, or why it leads nowhere.

    The first part of a path is a drive name, the rest are folder names; with
    ``allow_files`` the last may be a file. ``status`` is ``ok``, ``no_drive``,
    ``not_found`` or ``ambiguous``; ``segment``, ``kind`` and ``at_folder`` say
    which name failed, what was looked for and where.
    """
    asked = requests.select(F.struct("*").alias("asked"), path_parts().alias("parts"))
    found = with_drive(asked, drives)
    none = F.col("drive.id").isNull()
    state = found.select(
        "asked",
        F.col("drive.id").alias("at_folder"),
        F.coalesce("rest", "parts").alias("rest"),
        F.when(none, F.lit("no_drive")).alias("status"),
        F.when(none, F.get("parts", F.lit(0))).alias("segment"),
        F.when(none, F.lit("drive")).alias("kind"),
    )
    return _outcomes(_descend(state, files, "allDrives", allow_files))


def resolve_shared_paths(
    requests: DataFrame, files: DataFrame, allow_files: bool = False
) -> DataFrame:
    """Like ``resolve_paths`` for paths that start with a shared item.

    An item that ends the path may be a file only with ``allow_files``; an item
    with more to follow must be a folder (status ``not_a_folder``).
    """
    # The grand total stands for an empty name, which asks for any shared item.
    shared = (
        shared_items(files)
        .select(F.lower("name").alias("key"), "id", is_folder().alias("folder"))
        .rollup("key")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.min("id").alias("item"),
            F.bool_and("folder").alias("folder"),
            F.grouping("key").alias("all"),
        )
        .filter((F.col("all") == 1) | (F.col("key") != ""))
        .withColumn("shared_key", F.when(F.col("all") == 0, F.col("key")).otherwise(""))
        .drop("key", "all")
    )
    paths = requests.select(F.struct("*").alias("asked"), path_parts().alias("parts"))
    first = F.lower(F.get("parts", F.lit(0)))
    shared = scratch.store(shared, "shared")  # the join can split a hot first name
    seeded = paths.join(shared, first == F.col("shared_key"), "left")
    only_one = F.size("parts") == 1
    usable = F.col("folder") | (only_one & F.lit(allow_files))
    status = (
        F.when(F.col("items").isNull(), F.lit("not_found"))
        .when(F.col("items") > 1, F.lit("ambiguous"))
        .when(~usable, F.lit("not_a_folder"))
    )
    failed = status.isNotNull()
    state = seeded.select(
        "asked",
        F.when(~failed, F.col("item")).alias("at_folder"),
        F.slice("parts", F.lit(2), F.size("parts")).alias("rest"),
        status.alias("status"),
        F.when(failed, F.col("parts")[0]).alias("segment"),
        F.when(failed, F.lit("shared item")).alias("kind"),
    )
    return _outcomes(_descend(state, files, "user", allow_files))


def ambiguous_names(files: DataFrame, corpora: str = "allDrives") -> DataFrame:
    """Every live item whose name, in any case, is not unique in its folder.

    One row per item rather than one list per name, so a name with millions of
    copies stays spread out.
    """
    edges = child_edges(in_corpora(files, corpora)).select(
        F.col("parent").alias("location"),
        F.lower("name").alias("lname"),
        "name",
        "id",
        F.when(is_folder(), F.lit("folder")).otherwise(F.lit("file")).alias("kind"),
        F.coalesce(F.nullif(owner_email(), F.lit("")), F.lit("unknown")).alias("owner"),
    )
    clashes = (
        edges.groupBy("location", "lname")
        .agg(F.count(F.lit(1)).alias("matches"))
        .filter(F.col("matches") > 1)
    )
    # Stored, so that the join can split a name with very many copies.
    clashes = scratch.store(clashes, "clashes")
    return edges.join(clashes, ["location", "lname"])


def route_sources(requests: DataFrame, policy: str) -> DataFrame:
    """Adds ``route`` (url, path or id) and the id where none has to be looked up.

    ``export`` takes an id out of any text; ``download`` reads what is no link
    as a path; ``sheets`` reads text with a slash as a path, the rest as an id.
    """
    source = F.col("source")
    path_test: dict[str, Column] = {
        "export": F.lit(False),
        "download": ~is_url(source),
        "sheets": ~is_url(source) & F.contains(source, F.lit("/")),
    }
    if policy not in path_test:
        raise ValueError(f"policy must be one of {sorted(path_test)}, not {policy!r}")
    route = (
        F.when(is_url(source), F.lit("url"))
        .when(path_test[policy], F.lit("path"))
        .otherwise(F.lit("id"))
    )
    plain = F.lit(policy == "sheets") & (F.col("route") == "id")
    direct = F.when(plain, source).when(F.col("route") != "path", extract_id(source))
    return requests.withColumn("route", route).withColumn("id", direct)


def resolve_sources(
    requests: DataFrame, policy: str, files: DataFrame, drives: DataFrame
) -> DataFrame:
    """Adds ``route``, ``id`` and ``status`` to each ``source``."""
    routed = route_sources(requests, policy)
    status = F.when(F.col("id").isNull(), F.lit("no_id_in_url")).otherwise(F.lit("ok"))
    direct = routed.filter(F.col("route") != "path").withColumn("status", status)
    by_path = routed.filter(F.col("route") == "path").drop("id")
    resolved = resolve_paths(
        by_path.withColumn("path", F.col("source")), files, drives, allow_files=True
    )
    return direct.unionByName(resolved.select(*direct.columns))


def _descend(
    state: DataFrame, files: DataFrame, corpora: str, allow_files: bool
) -> DataFrame:
    """Follow ``rest`` from ``at_folder`` until each path has ended or failed.

    The longest path that gets anywhere sets the number of rounds, not the longest
    text.
    """
    is_open = F.col("status").isNull() & (F.size("rest") > 0)
    state, seen = scratch.measure(state, "paths", open=F.count_if(is_open))
    if not seen["open"]:
        return state
    names = state.filter(is_open).select(
        F.explode(F.transform("rest", lambda s: F.lower(s))).alias("lname")
    )
    index, kept = scratch.measure(
        name_index(files, corpora, names.distinct()),
        "names",
        size=F.sum(F.octet_length("parent") + F.octet_length("lname") + 128),
    )
    index = sized(index, kept["size"])
    while seen["open"]:
        heads = scratch.store(path_heads(state.filter(is_open)).distinct(), "heads")
        moved = _moved(state.filter(is_open), prefix_trie(heads, index), allow_files)
        state, seen = scratch.measure(
            state.filter(~is_open).unionByName(moved), "paths", open=F.count_if(is_open)
        )
    return state


def _head_names() -> list[str]:
    return [f"name{k}" for k in range(1, LEVELS + 1)]


def path_heads(paths: DataFrame, *keep: str) -> DataFrame:
    """``start`` and the next names of each path, in lower case, with ``keep``."""
    names = [
        F.coalesce(F.lower(F.get("rest", F.lit(k))), F.lit(ENDED)).alias(n)
        for k, n in enumerate(_head_names())
    ]
    return paths.select(*keep, F.col("at_folder").alias("start"), *names)


def prefix_trie(heads: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``last``, the last look-up on the way of each distinct head.

    A level has the distinct prefixes of its length. Each gets ``last`` from the
    prefix above it; if that led to one folder, and the path goes on, the next
    name is looked up there, else ``last`` stays.
    """
    names = _head_names()
    level = None
    for k, name in enumerate(names, 1):
        above = ["start", *names[: k - 1]]
        prefixes = heads.select(*above, name)
        if k < LEVELS:
            prefixes = prefixes.distinct()
        if level is None:
            looked = _look_up(prefixes.withColumn("folder", F.col("start")), name, k, index)
        else:
            led = F.when(F.col("last.folders") == 1, F.col("last.folder_child"))
            looked = _look_up(
                prefixes.join(level, above).withColumn("folder", led), name, k, index
            )
        level = looked.select(*above, name, "last")
    return level


def _look_up(prefixes: DataFrame, name: str, depth: int, index: DataFrame) -> DataFrame:
    """Joins prefixes with a ``folder`` to the names in it; the rest keep ``last``."""
    goes_on = F.col("folder").isNotNull() & (F.col(name) != ENDED)
    none = F.lit(0).cast("long")
    found = F.struct(
        F.lit(depth).alias("depth"),
        F.col("folder").alias("at"),
        F.coalesce("folders", none).alias("folders"),
        F.coalesce("items", none).alias("items"),
        F.col("folder_child"),
        F.col("item_child"),
    )
    last = F.when(F.col("goes_on"), found)
    if "last" in prefixes.columns:
        last = last.otherwise(F.col("last"))
    # A closed prefix is spread by its own text; no catalog name fits its key.
    spread = F.concat_ws(ENDED, *[c for c in prefixes.columns if c not in ("last", "folder")])
    keyed = prefixes.withColumn("goes_on", goes_on).withColumns(
        {
            "from_key": F.when(F.col("goes_on"), F.col("folder")).otherwise(spread),
            "name_key": F.when(F.col("goes_on"), F.col(name)).otherwise(F.lit(ENDED)),
        }
    )
    return keyed.join(
        index,
        (F.col("from_key") == F.col("parent")) & (F.col("name_key") == F.col("lname")),
        "left",
    ).withColumn("last", last)


def _moved(paths: DataFrame, trie: DataFrame, allow_files: bool) -> DataFrame:
    """Open paths behind the last look-up of their head: on, at their end, or failed."""
    heads = path_heads(paths, "asked", "rest")
    joined = heads.join(trie, ["start", *_head_names()])
    depth = F.col("last.depth")
    takes_file = (F.size("rest") == depth) & F.lit(allow_files)
    matches = F.when(takes_file, F.col("last.items")).otherwise(F.col("last.folders"))
    child = F.when(takes_file, F.col("last.item_child")).otherwise(
        F.col("last.folder_child")
    )
    wanted = F.when(takes_file, F.lit("file or folder")).otherwise(F.lit("folder"))
    failure = F.when(matches == 0, F.lit("not_found")).when(
        matches > 1, F.lit("ambiguous")
    )
    failed = matches != 1
    return joined.select(
        "asked",
        F.when(failed, F.col("last.at")).otherwise(child).alias("at_folder"),
        F.slice("rest", depth + 1, F.size("rest")).alias("rest"),
        failure.alias("status"),
        F.when(failed, F.get("rest", depth - 1)).alias("segment"),
        F.when(failed, wanted).alias("kind"),
    )


def _outcomes(state: DataFrame) -> DataFrame:
    ok = F.col("status").isNull()
    return state.select(
        "asked.*",
        F.when(ok, F.col("at_folder")).alias("id"),
        F.coalesce("status", F.lit("ok")).alias("status"),
        "segment",
        "kind",
        F.when(~ok, F.col("at_folder")).alias("at_folder"),
    )
