"""Schemas that drift between files: tagged-union inference over JSON records, one table of readings, one list of changes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.sources.tables import BROADCAST_ROWS

TYPES = ("boolean", "number", "string", "list", "object")

#: Names looked at first when a file's keys tell no difference. Roles are otherwise found by what the keys hold.
METRIC_NAMES, GROUP_NAMES, TIME_NAMES = ("metric",), ("group",), ("tp",)

FILE = ["feed", "file_no"]


#: The alternatives of the union by the first two letters of a variant's type; a variant read from JSON has no others, and null (VO) has none.
CODES = {"BO": "boolean", "BI": "number", "DE": "number", "DO": "number", "FL": "number", "ST": "string", "AR": "list", "OB": "object"}

_OBJECT, _LIST = "map<string,variant>", "array<variant>"


def _alternative(code: Column) -> Column:
    """Alternative of the union for a code; null for null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), code)


def _coded(entries: Column) -> Column:
    """Each entry of an object with its key, the code of its value's type (looked up once) and the value."""
    return F.transform(entries, lambda e: F.struct(e.key.alias("key"), F.left(F.schema_of_variant(e.value), F.lit(2)).alias("code"), e.value.alias("value")))


def _texted(coded: Column, with_value: bool) -> Column:
    """Coded entries with the text that could name a metric: a string, or a list of strings joined with '.'. with_value: the value as JSON too."""

    def one(e: Column) -> Column:
        path = F.when(F.schema_of_variant(e.value) == "ARRAY<STRING>", F.array_join(F.try_variant_get(e.value, "$", "array<string>"), "."))
        text = F.when(e.code == "ST", F.try_variant_get(e.value, "$", "string")).when(e.code == "AR", path)
        return F.struct(e.key.alias("key"), e.code.alias("code"), text.alias("text"), *([F.to_json(e.value).alias("json")] if with_value else []))

    return F.transform(coded, one)


def records(raw: DataFrame, with_value: bool = False) -> DataFrame:
    """feed, file_no, line_no, rec, tops and els: the distinct lines; tops and els are null where a line holds no JSON object.

    tops: key and code of each top key; els: of each element, an object in a list at the top, the keys with code and text. A string that holds a JSON list is read on as a list.
    Null lines and rows without feed or file number are left out. Lines delivered twice count once.
    Lines are spread by line, so that neither a hot feed nor a large file meets in one task; what moves is the text, the most compact form there is.
    Grouping by all columns keeps all of them in every branch that reads the lines, and unreadable ones are no filter's business that would go
    below the shuffle: so the branches share the one shuffle, each parsing only what it needs.
    """
    lines = raw.where("feed is not null and file_no is not null and body is not null").select(F.coalesce("feed", F.lit("")).alias("feed"), F.coalesce("file_no", F.lit(0)).alias("file_no"), "line_no", F.xxhash64("body").alias("rec"), F.coalesce("body", F.lit("")).alias("body"))
    lines = lines.repartition(*FILE, "line_no", "rec").distinct()
    lines = lines.select(*FILE, "line_no", "rec", _coded(F.map_entries(F.try_variant_get(F.try_parse_json("body"), "$", _OBJECT))).alias("top"))

    def inner(e: Column) -> Column:
        text = F.try_variant_get(e.value, "$", "string")
        return F.when(e.code == "AR", F.try_variant_get(e.value, "$", _LIST)).when((e.code == "ST") & F.ltrim(text).startswith("["), F.try_variant_get(F.try_parse_json(text), "$", _LIST))

    lists = F.filter(F.transform(F.filter("top", lambda e: e.code.isin("AR", "ST")), inner), lambda x: x.isNotNull())
    lines = lines.select(*FILE, "line_no", "rec", F.transform("top", lambda e: F.struct(e.key.alias("key"), e.code.alias("code"))).alias("tops"), F.flatten(lists).alias("items"))
    lines = lines.withColumn("items", F.filter(F.transform("items", lambda x: F.try_variant_get(x, "$", _OBJECT)), lambda x: x.isNotNull()))
    els = F.transform("items", lambda m: _texted(_coded(F.map_entries(m)), with_value))
    return lines.select(*FILE, "line_no", "rec", "tops", els.alias("els"))


def roles(recs: DataFrame) -> DataFrame:
    """feed, file_no, value_key, metric_key: which key of a file's elements holds the values and which the metric names, whatever they are called.

    The values are under the key that most often holds something else than text or a path. The metric names are under the key
    whose texts differ most within records (a group repeats, labels repeat), METRIC_NAMES and the longer texts deciding ties.
    """
    keys = recs.select(*FILE, "line_no", "rec", F.inline(F.flatten("els")))
    other = F.col("text").isNull() & (F.col("code") != "VO")
    # by line, where the line lies; then by file
    texts = keys.groupBy(*FILE, "line_no", "rec", "key", "text").agg(F.count("text").alias("n"), F.sum(other.cast("int")).alias("other"))
    per = texts.groupBy(*FILE, "key").agg(F.sum("n").alias("n"), F.count("text").alias("d"), F.sum("other").alias("other"), F.sum(F.coalesce(F.length("text"), F.lit(0)) * F.col("n")).alias("chars"))
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    pick = per.groupBy(*FILE).agg(
        F.max_by("key", F.when(F.col("other") > 0, F.struct("other", "key"))).alias("value_key"),
        F.max_by("key", F.when(F.col("n") > F.col("other"), F.struct(share("d").alias("ratio"), F.col("key").isin(*METRIC_NAMES).alias("named"), share("chars").alias("len"), "key"))).alias("metric_key"),
    )
    return pick.where("value_key is not null or metric_key is not null")


def _with_roles(recs: DataFrame, raw: DataFrame) -> DataFrame:
    """recs with the roles of their files' keys. There is at most one row a file, so the files, counted from two columns, tell whether the roles are few enough to be broadcast."""
    few = raw.select(*FILE).distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = roles(recs)
    return recs.join(F.broadcast(found) if few else found, FILE, "left")


def fields(raw: DataFrame) -> DataFrame:
    """The fused schema of each file: feed, file_no, records, level ('top' | 'element' | 'metric'), field, holders, and types, the count of each alternative.

    Every field of a file is listed, however few records hold it. Each line becomes a list of (level, field, alternative); what is counted is added up by
    line and then by file before it moves.
    """
    of = lambda e, key, what: F.get(F.filter(e, lambda k: k.key == F.col(key)), F.lit(0)).getField(what)
    row = lambda level, field, code: F.struct(F.lit(level).alias("level"), field.alias("field"), code.alias("code"))
    none = F.lit(None).cast("string")
    held = _with_roles(records(raw), raw)
    top = F.transform("tops", lambda t: row("top", t.key, t.code))
    # the key of the values has no type of its own
    key = F.transform(F.flatten("els"), lambda k: row("element", F.concat(F.lit("element."), k.key), F.when(~k.key.eqNullSafe(F.col("value_key")), k.code)))
    metric = F.transform("els", lambda e: row("metric", F.concat(F.lit("metric."), of(e, "metric_key", "text")), of(e, "value_key", "code")))
    whole = F.array(row("", F.lit(""), none))
    seen = held.select(*FILE, "line_no", "rec", F.inline(F.concat(whole, top, key, F.filter(metric, lambda m: m.field.isNotNull()))))
    # by line first, so that a line counts once however many elements hold the field
    of_type = lambda t: F.col("code").isin(*[c for c, x in CODES.items() if x == t])
    lines = seen.groupBy(*FILE, "level", "field", "line_no", "rec").agg(*[F.sum(F.when(of_type(t), 1).otherwise(0)).alias(t) for t in TYPES])
    per = lines.groupBy(*FILE, "level", "field").agg(F.count("*").alias("holders"), *[F.sum(t).alias(t) for t in TYPES])
    per = per.withColumn("records", F.max(F.when(F.col("level") == "", F.col("holders"))).over(Window.partitionBy(*FILE)))
    return per.where("level <> ''").select(*FILE, "records", "level", "field", "holders", *TYPES)


def changes(fused: DataFrame) -> DataFrame:
    """Every change from a file of a feed to the next: feed, file_no, change_kind ('added' | 'removed' | 'renamed' | 'retyped'), field_name, old_name, old_type, new_type.

    A field belongs to a file if more than half of its records hold it. Its type is the commonest alternative (of equally common ones
    the last known if among them, else the first in the order of TYPES); without any, the last known type goes on. Removed and added fields of
    one level are paired into renames in the order of their likeness: same type, then alike names. A feed's first file brings no change.
    """
    # numbers of the files, from one small row each
    order = Window.partitionBy("feed").orderBy("file_no")
    files = fused.select(*FILE).distinct().select(*FILE, F.row_number().over(order).alias("at"), F.lead("file_no").over(order).alias("next_file"))
    of = Window.partitionBy("feed", "level", "field").orderBy("at")
    there = fused.where(F.col("holders") * 2 > F.col("records")).join(files, FILE)
    counts = F.array(*[F.struct(F.col(t).alias("n"), F.lit(-i).alias("rank"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)])
    top = F.array_max(counts)
    there = there.withColumn("tied", F.transform(F.filter(counts, lambda c: (c.n > 0) & (c.n == top.n)), lambda c: c.t)).withColumn("first", F.when(top.n > 0, top.t))
    there = there.withColumn("known", F.last("first", True).over(of.rowsBetween(Window.unboundedPreceding, -1)))
    there = there.withColumn("type", F.when(F.array_contains("tied", F.col("known")), F.col("known")).otherwise(F.col("first")))
    there = there.withColumn("old", F.last("type", True).over(of.rowsBetween(Window.unboundedPreceding, -1)))
    there = there.withColumn("prev", F.lag("at").over(of)).withColumn("next", F.lead("at").over(of)).withColumn("now", F.coalesce("type", "old"))
    # what each field does in its file and the one after it: one pass, one list per file and level
    event = lambda kind, file_no, when: F.when(when, F.struct(F.lit(kind).alias("kind"), file_no.alias("file_no"), "field", F.col("now"), F.col("old")))
    retyped = event("retyped", F.col("file_no"), (F.col("prev") == F.col("at") - 1) & (F.col("type") != F.col("old")))
    came = event("came", F.col("file_no"), (F.col("at") > 1) & (F.col("prev").isNull() | (F.col("prev") < F.col("at") - 1)))
    went = event("went", F.col("next_file"), F.col("next_file").isNotNull() & (F.col("next").isNull() | (F.col("next") > F.col("at") + 1)))
    events = there.select("feed", "level", F.inline(F.filter(F.array(retyped, came, went), lambda e: e.isNotNull())))
    listed = lambda kind, *what: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct(*what)))).alias(kind)
    by_file = events.groupBy("feed", "file_no", "level").agg(listed("retyped", "field", "now", "old"), listed("came", "field", "now"), listed("went", "field", "now"))
    return _told(by_file).select("feed", "file_no", "change_kind", "field_name", "old_name", "old_type", "new_type")


def _row(kind: str, name: Column, old: Column, old_type: Column, new_type: Column) -> Column:
    return F.struct(F.lit(kind).alias("change_kind"), name.alias("field_name"), old.alias("old_name"), old_type.alias("old_type"), new_type.alias("new_type"))


def _alike(gone: Column, new: Column, same: bool) -> Column:
    """Renames among the fields that went and came, of the same type or of different ones: the unmatched pair most alike is taken again and again."""
    far = lambda a, b: F.struct(F.levenshtein(a.field, b.field).alias("far"), a.alias("g"), b.alias("n"))
    pairs = F.array_sort(F.flatten(F.transform(gone, lambda a: F.transform(F.filter(new, lambda b: a.now.eqNullSafe(b.now) == F.lit(same)), lambda b: far(a, b)))))
    free = lambda taken, p: ~F.exists(taken, lambda q: (q.g.field == p.g.field) | (q.n.field == p.n.field))
    none = F.array().cast("array<struct<far:int,g:struct<field:string,now:string>,n:struct<field:string,now:string>>>")
    return F.aggregate(pairs, none, lambda acc, p: F.when(free(acc, p), F.concat(acc, F.array(p))).otherwise(acc))


def _told(by_file: DataFrame) -> DataFrame:
    """The changes of each file and level, from its sorted lists of fields that were retyped, came and went. All are bounded by the fields of a file.

    Fields of one type are compared first; only what is left over, at most one side of each type, is compared across types.
    """
    rest = lambda side, taken, s: F.filter(side, lambda a: ~F.exists(taken, lambda q: q[s]["field"] == a.field))
    d = by_file.withColumn("first", _alike(F.col("went"), F.col("came"), True))
    d = d.withColumns({"went": rest("went", "first", "g"), "came": rest("came", "first", "n")})
    d = d.withColumn("second", _alike(F.col("went"), F.col("came"), False))
    none = F.lit(None).cast("string")
    renamed = F.transform(F.concat("first", "second"), lambda p: _row("renamed", p.n.field, p.g.field, p.g.now, p.n.now))
    removed = F.transform(rest("went", "second", "g"), lambda a: _row("removed", a.field, none, a.now, none))
    added = F.transform(rest("came", "second", "n"), lambda b: _row("added", b.field, none, none, b.now))
    same = F.transform("retyped", lambda r: _row("retyped", r.field, none, r.old, r.now))
    return d.select("feed", "file_no", F.inline(F.concat(renamed, removed, added, same)))


def readings(raw: DataFrame) -> DataFrame:
    """One consistent table of all readings of all files, however the files name and type things.

    feed, file_no, line_no, item_no, metric, alternative (of the value), one typed branch per alternative (v_boolean, v_number, v_string, v_list, v_object;
    lists and objects as JSON text), and v_canonical, the conversion to a number: of booleans 0 or 1, of texts that hold a number with or without a
    sign, mark or unit, of objects their field n or value, of lists the total count (last part of each item); null where there is none.
    Conflicting types are kept apart in the branches and never drop a row.
    """
    held = _with_roles(records(raw, with_value=True), raw)
    of = lambda key, what: F.get(F.filter("el", lambda k: k.key == F.col(key)), F.lit(0)).getField(what)
    one = held.select(*FILE, "line_no", "value_key", "metric_key", F.posexplode("els").alias("item_no", "el"))
    one = one.where(F.exists("el", lambda k: (k.key == F.col("value_key")) | (k.key == F.col("metric_key"))))
    one = one.select(*FILE, "line_no", "item_no", of("metric_key", "text").alias("metric"), _alternative(of("value_key", "code")).alias("alternative"), of("value_key", "json").alias("json"))
    v = F.try_parse_json("json")
    text = F.when(F.col("alternative") == "string", F.try_variant_get(v, "$", "string"))
    number = F.when(F.col("alternative") == "number", F.try_variant_get(v, "$", "double"))
    truth = F.when(F.col("alternative") == "boolean", F.try_variant_get(v, "$", "boolean"))
    listed = F.when(F.col("alternative") == "list", F.try_variant_get(v, "$", "array<array<double>>"))
    total = F.aggregate(listed, F.lit(0.0), lambda a, x: a + F.coalesce(F.get(x, F.size(x) - 1), F.lit(0.0)))
    part = F.when(F.col("alternative") == "object", F.coalesce(F.try_variant_get(v, "$.n", "double"), F.try_variant_get(v, "$.value", "double")))
    canonical = F.coalesce(number, truth.cast("int").cast("double"), F.regexp_extract(text, r"^\s*[~≈<>=]*\s*([+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), part, total)
    return one.select(
        *FILE, "line_no", "item_no", "metric", "alternative",
        truth.alias("v_boolean"), number.alias("v_number"), text.alias("v_string"),
        F.when(F.col("alternative") == "list", F.col("json")).alias("v_list"), F.when(F.col("alternative") == "object", F.col("json")).alias("v_object"),
        canonical.alias("v_canonical"),
    )
