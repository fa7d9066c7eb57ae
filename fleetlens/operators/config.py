"""Layered key/value configuration in long form.

``entries(doc, section, component, key, value)`` where section is ``global``,
``metadata`` or ``component``; component is null outside components. An optional
``tree`` column names the tree an entry belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ordered import BROADCAST_BYTES, BROADCAST_ROWS, join_one
from fleetlens.functions.text import after, decode_int, starts
from fleetlens.session import durable

# fixed values
SCHEMA_VERSION = "http://example.org/specification/v2.0.0"
SITE_PREFIX = "site."
ENV_PREFIX = "env."
KEY_CORES, DEFAULT_CORES = "yarn.vcores", 1
KEY_MEMORY, DEFAULT_MEMORY = "yarn.memory", 256
KEY_INSTANCES = "component.instances"
MAX_RESOURCE = "max"
MAX_SUBSTITUTIONS = 19
TREE_ORDER = ("internal", "app_conf", "resources")


def _components(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("section") == "component")


def _globals(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("section") == "global")


def resolve_config(entries: DataFrame) -> DataFrame:
    """Give every component each global key it lacks; ``origin`` tells where it is from.

    A component that has no keys of its own is present as an entry with a null key.
    The result has components x globals rows per document by definition; the join is
    on the document, and adaptive skew handling splits a document with many components.
    """
    own = _components(entries)
    names = own.select("doc", "component").distinct()
    shared = names.join(_globals(entries).select("doc", "key", "value"), "doc")
    keyed = own.filter(F.col("key").isNotNull()).select("doc", "component", "key", "value")
    lacking = shared.join(keyed.select("doc", "component", "key"), ["doc", "component", "key"], "left_anti")
    return keyed.withColumn("origin", F.lit("component")).unionByName(
        lacking.withColumn("origin", F.lit("global")))


def _merge(base: DataFrame, other: DataFrame, overwrite: Column) -> DataFrame:
    keys = ["doc", "section", "component", "key"]
    plain = F.coalesce("component", F.lit("")).alias("component")
    left = base.select("doc", "section", plain, "key", F.col("value").alias("_b"), F.lit(True).alias("_hb"))
    right = other.select("doc", "section", plain, "key", F.col("value").alias("_o"), F.lit(True).alias("_ho"))
    both = left.join(right, keys, "full")
    value = F.when(F.col("_ho") & (overwrite | F.col("_hb").isNull()), F.col("_o")).otherwise(F.col("_b"))
    return both.select("doc", "section", F.when(F.col("section") == "component", F.col("component")).alias("component"),
                       "key", value.alias("value"))


def merge_config(base: DataFrame, over: DataFrame) -> DataFrame:
    """Two layers of each document together; the second one wins."""
    return _merge(base, over, F.lit(True))


def merge_config_keep(base: DataFrame, extra: DataFrame) -> DataFrame:
    """As ``merge_config`` but the first layer wins, except for metadata."""
    return _merge(base, extra, F.col("section") == "metadata")


def merge_prefixed(base: DataFrame, extra: DataFrame, prefix: str, overwrite: bool) -> DataFrame:
    """Merge only the component keys of ``extra`` that start with ``prefix``."""
    wanted = _components(extra).filter(starts(F.col("key"), prefix))
    return _merge(base, wanted, F.lit(overwrite))


def propagate_globals(target: DataFrame, source: DataFrame, prefix: str) -> DataFrame:
    """Copy prefixed global keys of another tree over those of ``target``."""
    return _merge(target, _globals(source).filter(starts(F.col("key"), prefix)), F.lit(True))


def site_options(entries: DataFrame, config_name: str = "", tokens: dict[str, str] | None = None) -> DataFrame:
    """Keys under the site prefix without it, with literal tokens replaced in values."""
    prefix = SITE_PREFIX + (config_name + "." if config_name else "")
    value = F.col("value")
    for token, text in (tokens or {}).items():
        value = F.replace(value, F.lit(token), F.lit(text))
    found = entries.filter(starts(F.col("key"), prefix) & (F.length("key") > len(prefix)))
    return found.withColumns({"key": after(F.col("key"), prefix), "value": value})


def env_options(entries: DataFrame) -> DataFrame:
    """Environment variables set by a configuration."""
    found = entries.filter(starts(F.col("key"), ENV_PREFIX) & (F.length("key") > len(ENV_PREFIX)))
    return found.withColumn("key", after(F.col("key"), ENV_PREFIX))


# fixed value: a variable reference; the class also leaves out NUL, 2 and 0
_VARIABLE = r"\$\{[^}$\x0020]+\}"


def substitute_vars(entries: DataFrame, scope: tuple[str, ...] = ("doc", "component")) -> DataFrame:
    """Replace ``${key}`` in values by other values of the same scope.

    One reference per round, the leftmost innermost first, at most 19 rounds; a value
    stops at the first unknown name. Every round is a join of the values still open
    with the raw entries they name, so no document has to fit into one row; values that
    name a variable which very many others name are dealt over shares. After every
    round the values are written out, finished ones are set aside, and the work
    ends as soon as nothing is open. A key is expected once in its scope.
    """
    def place(name: str) -> Column:  # null has a place of its own
        return F.concat_ws("\u0000", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0001")) for k in scope], F.col(name))
    raw = durable(entries.filter(F.col("key").isNotNull()).select(place("key").alias("_at"), F.col("value").alias("_v")))

    def reference(value: Column) -> Column:
        found = F.regexp_extract(value, f"({_VARIABLE})", 1)
        return F.when(found != "", F.substring(found, F.lit(3), F.length(found) - 3))

    value, start = F.col("value"), F.regexp_instr(F.col("value"), F.lit(f"({_VARIABLE})"))
    swapped = F.concat(F.substring(value, F.lit(1), start - 1), F.col("_v"),
                       F.substring(value, start + F.length("_name") + 3, F.lit(2147483647)))
    columns = entries.columns
    pending = entries.withColumn("_name", reference(value))
    finished = [pending.filter(F.col("_name").isNull()).select(*columns)]
    pending = pending.filter(F.col("_name").isNotNull())
    known = F.col("_v").isNotNull()
    for _ in range(MAX_SUBSTITUTIONS):
        pending = durable(
            join_one(pending.withColumn("_at", place("_name")), raw, ["_at"], ["key"], "left", written=True)
            .withColumn("value", F.when(known, swapped).otherwise(value))
            .withColumn("_name", F.when(known, reference(value))).select(*columns, "_name"))
        finished.append(pending.filter(F.col("_name").isNull()).select(*columns))
        pending = pending.filter(F.col("_name").isNotNull())
        if pending.isEmpty():
            break
    else:
        finished.append(pending.select(*columns))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def config_lookup(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Answer option requests ``wanted(doc, component, key, default)``.

    A null component asks for a global option. ``int_value`` is the number the value
    stands for, null when it is not one.
    """
    have = entries.filter(F.col("section") != "metadata").filter(F.col("key").isNotNull()).select(
        "doc", F.coalesce("component", F.lit("")).alias("_c"), "key", "value")
    asked = wanted.withColumn("_c", F.coalesce("component", F.lit("")))
    value = F.coalesce("value", "default")
    return asked.join(have, ["doc", "_c", "key"], "left").select(
        "doc", "component", "key", value.alias("value"), decode_int(value).alias("int_value"))


def missing_mandatory(entries: DataFrame, required: DataFrame) -> DataFrame:
    """Required options that are not set; a null ``key`` requires the component itself.

    ``required(doc, component, key)``. An empty value counts as not set.
    """
    own = _components(entries)
    set_keys = own.filter(F.length("value") > 0).select("doc", "component", "key")
    keys = required.filter(F.col("key").isNotNull()).join(set_keys, ["doc", "component", "key"], "left_anti")
    comps = required.filter(F.col("key").isNull()).join(
        own.select("doc", "component").distinct(), ["doc", "component"], "left_anti")
    return keys.unionByName(comps.select(*keys.columns))


# fixed value: legal application names
NAME_PATTERN = "^[a-z][a-z0-9_-]*$"


def is_legal_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME_PATTERN), F.lit(False))


def heap_megabytes(text: Column) -> Column:
    """Heap size in megabytes: ``m`` is dropped, ``g`` appends three zeros; null when malformed."""
    unit = F.lower(F.substring(text, -1, 1))
    body = F.when(unit.isin("m", "g"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    number = F.when(unit == "g", F.concat(body, F.lit("000"))).otherwise(body)
    return F.when(number.rlike("^[+-]?[0-9]+$"), number.try_cast("int"))


SHAPES = 32  # different numbers of dots among rules, beyond which all tails are looked up


def audit_config(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries that break a rule.

    ``rules(key_suffix, rule, min, max)``: a rule applies to keys that are the suffix or
    end in it after a dot; a suffix may contain dots. Rules are ``int`` (a bound of -1 is
    none), ``count`` (a max of 0 is none), ``heap``, ``name`` and ``schema``. Every key is
    looked up by those of its tails that have as many dots as some rule, so the work is one
    equi-join however many rules there are. Rules are read twice and should be a written table.
    """
    dotted = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("."), F.lit(""))) + 1
    tail = lambda n: F.call_function("substring_index", F.col("key"), F.lit("."), -n)
    # one row for each number of dots: how many rules, and their size
    shapes = rules.groupBy(dotted("key_suffix").alias("parts")).agg(
        F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*rules.columns)))).alias("bytes")).limit(SHAPES + 1).collect()
    if len(shapes) > SHAPES:
        tails = F.transform(F.sequence(F.lit(1), dotted("key")), tail)
    else:
        tails = F.array(*[F.when(dotted("key") >= r.parts, tail(F.lit(r.parts))) for r in shapes]).cast("array<string>")
        if sum(r.n for r in shapes) <= BROADCAST_ROWS and sum(r.bytes for r in shapes) <= BROADCAST_BYTES:
            rules = F.broadcast(rules)
    hit = entries.filter(F.col("key").isNotNull()).withColumn("key_suffix", F.explode(tails)).join(rules, "key_suffix")
    # read once behind the join; put into the conditions, the number's expression would be worked out for each of them
    hit = hit.withColumn("_number", F.explode(F.array(F.when(F.col("rule").isin("int", "count"), decode_int(F.trim("value"))))))
    number = F.col("_number")
    low = F.when((F.col("rule") == "count") | (F.col("min") >= 0), F.col("min"))
    high = F.when(F.when(F.col("rule") == "count", F.col("max") > 0).otherwise(F.col("max") >= 0), F.col("max"))
    ranged = F.col("rule").isin("int", "count")
    detail = (
        F.when(ranged & number.isNull(), "not a number")
        .when(ranged & (number < low), F.concat(F.lit("below "), low.cast("string")))
        .when(ranged & (number > high), F.concat(F.lit("above "), high.cast("string")))
        .when((F.col("rule") == "heap") & heap_megabytes(F.col("value")).isNull(), "bad heap size")
        .when((F.col("rule") == "name") & ~is_legal_name(F.col("value")), "bad name")
        .when((F.col("rule") == "schema") & ~F.col("value").eqNullSafe(F.lit(SCHEMA_VERSION)), "unsupported version"))
    return hit.select("doc", "section", "component", "key", "value", "rule", F.explode(F.array(detail)).alias("detail")).filter(
        F.col("detail").isNotNull())


def resource_requirement(entries: DataFrame, max_cores: int, max_memory: int,
                         cores_key: str = KEY_CORES, memory_key: str = KEY_MEMORY) -> DataFrame:
    """Cores and megabytes each component asks for; ``max`` means the cluster's limit."""
    def need(key: str, default: int, limit: int) -> Column:
        text = F.max(F.when(F.col("key") == key, F.col("value")))
        return F.when(text.isNull(), F.lit(default)).when(text == MAX_RESOURCE, F.lit(limit)).otherwise(decode_int(text))

    return _components(entries).groupBy("doc", "component").agg(
        need(cores_key, DEFAULT_CORES, max_cores).alias("cores"),
        need(memory_key, DEFAULT_MEMORY, max_memory).alias("memory"))


def flatten_trees(entries: DataFrame) -> DataFrame:
    """One option and one role map out of three trees; the earlier tree wins.

    Components are resolved against the globals of their own tree first.
    """
    order = F.array_position(F.array(*[F.lit(t) for t in TREE_ORDER]), F.col("tree")).cast("int")
    scoped = entries.withColumn("doc", F.struct("doc", "tree"))
    roles = resolve_config(scoped).select(
        F.col("doc.doc").alias("doc"), F.col("doc.tree").alias("tree"), "component", "key", "value")
    options = _globals(entries).select("doc", "tree", F.lit(None).cast("string").alias("component"), "key", "value")
    both = options.unionByName(roles).withColumn("_o", order)
    return both.groupBy("doc", "component", "key").agg(
        F.min_by("value", "_o").alias("value"), F.min_by("tree", "_o").alias("tree"))


def diff_desired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Roles whose desired count changes; ``is_new`` marks those that need a priority.

    Both sides are ``(name, desired)``; a role that is missing means zero.
    """
    o = old.select("name", F.col("desired").alias("_o"))
    n = new.select("name", F.col("desired").alias("_n"))
    before, now = F.coalesce("_o", F.lit(0)), F.coalesce("_n", F.lit(0))
    return o.join(n, "name", "full").filter((before != now) | F.col("_o").isNull()).select(
        "name", before.alias("old_desired"), now.alias("new_desired"), F.col("_o").isNull().alias("is_new"))


def override_audit(entries: DataFrame) -> DataFrame:
    """Sorted dump of effective values and where each one comes from."""
    resolved = resolve_config(entries)
    given = _globals(entries).select("doc", "key", F.col("value").alias("global_value"))
    return resolved.join(given, ["doc", "key"], "left").select(
        "doc", "component", "key", "value", "origin",
        ((F.col("origin") == "component") & F.col("global_value").isNotNull()).alias("overrides"),
    ).orderBy("doc", "component", "key")


def config_doc_json(entries: DataFrame, line_entries: int = 10_000) -> DataFrame:
    """Long rows into JSON lines ``doc, json``; every line is a valid tree that names its document.

    The keys of a document are dealt over lines of about ``line_entries`` keys. Reading all
    lines of a document gives its entries again, whatever their number. Of entries that
    repeat a key in a component or section the greatest value stays.
    """
    unique = entries.groupBy("doc", "section", "component", "key").agg(F.max("value").alias("value"))
    lines = unique.groupBy("doc").agg(F.ceil(F.count("*") / line_entries).alias("_lines"))
    dealt = unique.join(lines, "doc").withColumn(
        "_line", F.pmod(F.xxhash64("section", "component", "key"), F.col("_lines")))
    pair = F.when(F.col("key").isNotNull(), F.struct("key", "value"))
    maps = dealt.groupBy("doc", "_line", "section", "component").agg(
        F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("options"))
    section = lambda s: F.first(F.when(F.col("section") == s, F.col("options")), ignorenulls=True)
    empty = F.create_map().cast("map<string,string>")
    trees = maps.groupBy("doc", "_line").agg(
        section("metadata").alias("metadata"), section("global").alias("global"),
        F.sort_array(F.collect_list(F.when(F.col("section") == "component", F.struct(
            "component", F.map_entries("options").alias("pairs"))))).alias("components"))
    tree = F.struct(
        "doc", F.lit(SCHEMA_VERSION).alias("schema"),
        F.coalesce("metadata", empty).alias("metadata"), F.coalesce("global", empty).alias("global"),
        F.map_from_entries(F.transform("components", lambda c: F.struct(
            c["component"], F.map_from_entries(c["pairs"])))).alias("components"))
    return trees.select("doc", F.to_json(tree).alias("json"))
