import pytest
from pyspark.sql import functions as F

from fleetlens.operators import config as c
from fleetlens.sources import config_docs as docs

SCHEMA = "doc string, section string, component string, key string, value string"
OVERRIDDEN = """{"schema": "http://example.org/specification/v2.0.0", "extra": [1],
 "global": {"zone": "north", "level": "3"},
 "components": {"bare": {}, "gate": {"zone": "south", "port": "80"}, "store": {"zone": "east", "label": "s", "wait": "9"}}}"""


@pytest.fixture(scope="module")
def trees(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("conf")
    (folder / "overridden.json").write_text(OVERRIDDEN)
    (folder / "wrong.json").write_text('{"schema": "http://example.org/specification/v1.0.0", "global": {}}')
    (folder / "bad.json").write_text("{ this is not, json\n")
    (folder / "none.json").write_text('{"global": {"a": "1"}}')
    return docs.read_config_trees(spark, str(folder)).cache()


def as_map(df):
    return {(r.component, r.key): r.value for r in df.collect()}


def test_resolve(trees):
    entries = docs.config_entries(trees).filter("doc = 'overridden'")
    assert as_map(c.resolve_config(entries)) == {
        ("bare", "zone"): "north", ("bare", "level"): "3",
        ("gate", "port"): "80", ("gate", "zone"): "south", ("gate", "level"): "3",
        ("store", "label"): "s", ("store", "zone"): "east", ("store", "level"): "3", ("store", "wait"): "9"}


def test_rejected(trees):
    assert {r.doc: r.reason for r in docs.rejected_docs(trees).collect()} == {
        "wrong": "unsupported version", "bad": "not JSON", "none": "version undefined"}


def tree(n, text="v"):
    return '{"schema": "http://example.org/specification/v2.0.0", "global": {"n": "%d", "t": "%s"}}' % (n, text)


def test_several_trees_in_a_file(spark, tmp_path):
    odd = r'a } \\ \" [ { é'
    (tmp_path / "two.json").write_text(tree(1) + "\n" + tree(2, odd))
    (tmp_path / "list.json").write_text(" [" + tree(3) + ", " + tree(4, odd) + "]")
    (tmp_path / "cut.json").write_text(tree(5) + tree(6)[:-2])
    (tmp_path / "tail.json").write_text(tree(7) + " rest" + tree(8) + "}")
    (tmp_path / "quote.json").write_text(tree(9) + ' "')
    (tmp_path / "bad.json").write_text("[1, 2")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "blank.json").write_text(" \n\t")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "two.json").write_text(tree(10))
    trees = docs.read_config_trees(spark, [str(tmp_path), str(tmp_path / "more")]).cache()
    got = sorted((r.doc, r.key, r.value) for r in docs.config_entries(trees).collect())
    v, o = "v", 'a } \\ " [ { é'
    want = [("two", 1, v), ("two#2", 2, o), ("list", 3, v), ("list#2", 4, o), ("cut", 5, v), ("tail", 7, v), ("quote", 9, v), ("two", 10, v)]
    assert got == sorted(x for d, n, t in want for x in ((d, "n", str(n)), (d, "t", t)))
    bad = sorted((r.doc, r.reason) for r in docs.rejected_docs(trees).collect())
    assert bad == [("bad", "not JSON"), ("cut#2", "not JSON"), ("quote#2", "not JSON"), ("tail#2", "not JSON"), ("tail#3", "not JSON")]


def test_hot_variable_and_dealt_rows(spark, monkeypatch):
    """A variable that almost all values name, with a low limit for hot keys and no broadcast."""
    from fleetlens.functions import ordered
    rows = [("d", "global", None, "hot", "${deep}"), ("d", "global", None, "deep", "x"), ("d", "global", None, "name", "ho")]
    rows += [("d", "global", None, f"k{i}", "a ${hot} b ${%s} ${none}" % ("deep" if i % 2 else "${name}t")) for i in range(300)]
    entries = spark.createDataFrame(rows, SCHEMA)
    want = as_map(c.substitute_vars(entries))
    assert want[None, "k1"] == "a x b x ${none}" and want[None, "k2"] == "a x b x ${none}"
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ordered, "HOT_ROWS", 20)
    assert as_map(c.substitute_vars(entries)) == want


@pytest.mark.parametrize("line_entries", [10_000, 3])
def test_round_trip(spark, trees, tmp_path, line_entries):
    rows = [(f"d{n}", "component", f"c{i % 3}", f"k{i}", str(i * n)) for n in range(5) for i in range(10 * n + 1)]
    rows += [(f"d{n}", s, None, "g", "1") for n in range(5) for s in ("global", "metadata")] + [("d0", "component", "bare", None, None)]
    entries = docs.config_entries(trees).filter("doc = 'overridden'").unionByName(spark.createDataFrame(rows, SCHEMA))
    lines = c.config_doc_json(entries, line_entries)
    assert lines.count() >= (6 if line_entries == 10_000 else 40)
    want = sorted(map(tuple, entries.select("doc", "section", "component", "key", "value").collect()), key=repr)
    got = docs.config_entries(docs.parse_lines(lines.select(F.col("json").alias("value"))))
    assert sorted(map(tuple, got.select("doc", "section", "component", "key", "value").collect()), key=repr) == want
    docs.write_config_docs(entries, str(tmp_path / "out"))
    back = docs.read_config_docs(spark, str(tmp_path / "out"), lines=True)
    assert sorted(map(tuple, back.select("doc", "section", "component", "key", "value").collect()), key=repr) == want


def test_repeated_key_keeps_the_greatest_value(spark):
    entries = spark.createDataFrame([("d", "global", None, "k", "1"), ("d", "global", None, "k", "2")], SCHEMA)
    got = docs.config_entries(docs.parse_lines(c.config_doc_json(entries).select(F.col("json").alias("value"))))
    assert [(r.key, r.value) for r in got.collect()] == [("k", "2")]


RAW = {
    "base.n": "42", "copy.n": "${base.n}", "miss.any": "a${nowhere}b", "miss.none": "${}",
    "miss.blank": "${ two words}", "digit.0": "unused", "miss.digit": "${digit.0}", "part.a": "left",
    "part.b": "-right", "chain.ok": "${part.a}${part.b}${copy.n}",
    "chain.a": "${part.a}${nowhere}${copy.n}",
    "chain.b": "${part.a}${chain.a}${copy.n}",
    "ref.n": "base.n", "via.ref": "${${ref.n}}", "self.ref": "${self.ref}"}
CHANGED = {
    "copy.n": "42", "chain.ok": "left-right42", "chain.a": "left${nowhere}${copy.n}",
    "chain.b": "leftleft${nowhere}${copy.n}${copy.n}", "via.ref": "42"}


def test_substitute(spark):
    df = spark.createDataFrame([("d", "global", None, k, x) for k, x in RAW.items()], SCHEMA)
    got = {r.key: r.value for r in c.substitute_vars(df).collect()}
    assert got == {**RAW, **CHANGED}


def test_substitute_sends_no_large_table_through_the_driver(spark, monkeypatch):
    from fleetlens.functions import ordered
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    plans, written = [], c.durable
    monkeypatch.setattr(c, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    df = spark.createDataFrame([("d", "global", None, k, x) for k, x in RAW.items()], SCHEMA)
    assert {r.key: r.value for r in c.substitute_vars(df).collect()} == {**RAW, **CHANGED}
    assert any("Join" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert all(p.count("SortMergeJoin") <= 1 for p in plans)  # no round is worked out again for a later one


def test_substitute_stays_in_scope(spark):
    df = spark.createDataFrame([("d", "component", "a", "x", "${y}"), ("d", "component", "b", "y", "1")], SCHEMA)
    assert as_map(c.substitute_vars(df))[("a", "x")] == "${y}"
    assert as_map(c.substitute_vars(df, scope=("doc",)))[("a", "x")] == "1"


def test_merges(spark):
    base = spark.createDataFrame([("d", "global", None, "a", "1"), ("d", "metadata", None, "m", "1"),
                                  ("d", "component", "w", "p.x", "1")], SCHEMA)
    over = spark.createDataFrame([("d", "global", None, "a", "2"), ("d", "metadata", None, "m", "2"),
                                  ("d", "component", "w", "p.x", "2"), ("d", "component", "n", "y", "2"),
                                  ("d", "global", None, "p.g", "2")], SCHEMA)
    full = lambda d: {(r.section, r.component, r.key): r.value for r in d.collect()}
    assert set(full(c.merge_config(base, over)).values()) == {"2"}
    kept = full(c.merge_config_keep(base, over))
    assert kept[("global", None, "a")] == "1" and kept[("metadata", None, "m")] == "2" and kept[("component", "n", "y")] == "2"
    assert full(c.merge_prefixed(base, over, "p.", False)) == full(base)
    assert full(c.merge_prefixed(base, over, "p.", True))[("component", "w", "p.x")] == "2"
    assert full(c.propagate_globals(base, over, "p."))[("global", None, "p.g")] == "2"


def test_site_and_env(spark):
    df = spark.createDataFrame([("d", "global", None, k, x) for k, x in [
        ("site.", "no"), ("site.core.a", "$Xy"), ("env.A", "4"), ("env.", "no"), ("other", "no")]], SCHEMA)
    assert [(r.key, r.value) for r in c.site_options(df, "core", {"$X": "z"}).collect()] == [("a", "zy")]
    assert [(r.key, r.value) for r in c.env_options(df).collect()] == [("A", "4")]


@pytest.mark.parametrize("text, number", [
    ("42", 42), ("-7", -7), ("+7", 7), ("0x1F", 31), ("-0x1f", -31), ("#ff", 255), ("010", 8), ("0", 0), ("08", None),
    ("abc", None), ("", None), ("2147483647", 2147483647), ("2147483648", None), ("-2147483648", -2147483648), ("0x", None), ("0x" + "0" * 30 + "1F", 31),
    ("0" * 40 + "17", 15), ("00", 0), ("#" + "0" * 20, 0)])
def test_decode_int(spark, text, number):
    from fleetlens.functions.text import decode_int
    assert spark.createDataFrame([(text,)], "t string").select(decode_int(F.col("t"))).first()[0] == number


@pytest.mark.parametrize("options, need", [
    ({"yarn.memory": "512", "yarn.vcores": "2"}, (2, 512)), ({"yarn.memory": "max", "yarn.vcores": "2"}, (2, 4096)),
    ({"yarn.memory": "512", "yarn.vcores": "max"}, (64, 512)), ({"x": "1"}, (1, 256))])
def test_resources(spark, options, need):
    df = spark.createDataFrame([("d", "component", "w", k, x) for k, x in options.items()], SCHEMA)
    r = c.resource_requirement(df, 64, 4096).first()
    assert (r.cores, r.memory) == need


def test_names(spark):
    good = ["cluster", "cluster1", "very-very-very-long-cluster-name", "c1234567890"]
    bad = ["", " ", "-hyphen", "Title", "UPPER-CASE-CLUSTER", "a[a", "[", "[a", "#", "@", "=", "*", ".", "b#", "c@",
           "d=", "e*", "f.", "g ", "h i", None]
    df = spark.createDataFrame([(n,) for n in good + bad], "n string").select("n", c.is_legal_name(F.col("n")).alias("ok"))
    assert [r.n for r in df.collect() if r.ok] == good


def test_heap(spark):
    cases = {"512": 512, "512m": 512, "512M": 512, "2g": 2000, "2G": 2000, "x": None, "2k": None}
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", c.heap_megabytes(F.col("h")).alias("mb"))
    assert {r.h: r.mb for r in df.collect()} == cases


def test_audit(spark):
    df = spark.createDataFrame([("d", "component", "w", k, x) for k, x in [
        ("a.port", "70000"), ("b.port", "80"), ("jvm.heap", "1z"), ("n.count", "0"), ("app.name", "Bad"), ("c.port", "q"),
        ("the.schema", c.SCHEMA_VERSION), ("old.schema", "1"), ("component.instances", "-5"), ("x.yarn.memory", "abc"), ("memory", "abc")]], SCHEMA)
    rules = spark.createDataFrame([("port", "int", -1, 65535), ("heap", "heap", -1, -1), ("count", "count", 1, 0),
                                   ("name", "name", -1, -1), ("schema", "schema", -1, -1), ("component.instances", "int", 0, -1), ("yarn.memory", "int", 0, -1)],
                                  "key_suffix string, rule string, min int, max int")
    assert {r.key: r.detail for r in c.audit_config(df, rules).collect()} == {
        "a.port": "above 65535", "jvm.heap": "bad heap size", "n.count": "below 1", "app.name": "bad name",
        "c.port": "not a number", "old.schema": "unsupported version", "component.instances": "below 0", "x.yarn.memory": "not a number"}


def test_mandatory(spark):
    df = spark.createDataFrame([("d", "component", "w", "a", "1"), ("d", "component", "w", "b", "")], SCHEMA)
    need = spark.createDataFrame([("d", "w", "a"), ("d", "w", "b"), ("d", "z", None), ("d", "w", None)],
                                 "doc string, component string, key string")
    assert sorted(map(tuple, c.missing_mandatory(df, need).collect()), key=repr) == [("d", "w", "b"), ("d", "z", None)]


def test_lookup(spark):
    df = spark.createDataFrame([("d", "component", "w", "a", "0x10"), ("d", "global", None, "a", "010")], SCHEMA)
    ask = spark.createDataFrame([("d", "w", "a", "1"), ("d", None, "a", "1"), ("d", "w", "z", "7")],
                                "doc string, component string, key string, default string")
    got = {(r.component, r.key): (r.value, r.int_value) for r in c.config_lookup(df, ask).collect()}
    assert got == {("w", "a"): ("0x10", 16), (None, "a"): ("010", 8), ("w", "z"): ("7", 7)}


def test_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, desired int")
    new = spark.createDataFrame([("a", 1), ("b", 5), ("n", 1)], "name string, desired int")
    got = {r.name: (r.old_desired, r.new_desired, r.is_new) for r in c.diff_desired(old, new).collect()}
    assert got == {"b": (2, 5, False), "c": (3, 0, False), "n": (0, 1, True)}
