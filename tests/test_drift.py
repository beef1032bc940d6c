import json
from collections import Counter, defaultdict

from tsq.operators import drift
from tsq.sources.tables import table

SCHEMA = "feed string, file_no int, file_name string, line_no int, arrived_at timestamp, body string"


def kind(x):
    return None if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "list" if isinstance(x, list) else "object"


def brute(rows):
    files = defaultdict(dict)
    for feed, no, line, body in rows:
        if feed is None or no is None or not body:
            continue
        try:
            o = json.loads(body)
        except ValueError:
            continue
        if isinstance(o, dict):
            files[feed, no][line, body] = o
    schemas = {}
    for f, recs in files.items():
        elements = []
        for o in recs.values():
            es = []
            for v in o.values():
                if isinstance(v, str) and v.startswith("["):
                    v = json.loads(v)
                if isinstance(v, list):
                    es += [e for e in v if isinstance(e, dict)]
            elements.append(es)
        values, distinct, texts = Counter(), Counter(), Counter()
        path = lambda v: v if isinstance(v, str) else ".".join(v) if isinstance(v, list) and v and all(isinstance(p, str) for p in v) else None
        for es in elements:
            names = defaultdict(list)
            for e in es:
                for k, v in e.items():
                    values[k] += v is not None and path(v) is None
                    if path(v) is not None:
                        names[k].append(path(v))
            for k, ns in names.items():
                distinct[k] += len(set(ns))
                texts[k] += len(ns)
        value_key = max((k for k in values if values[k]), key=lambda k: values[k], default=None)
        metric_key = max((k for k in texts if texts[k] > values[k]), key=lambda k: (distinct[k] / texts[k], k == "metric"), default=None)
        held, types = Counter(), defaultdict(Counter)
        for o, es in zip(recs.values(), elements):
            seen = set()
            for k, v in o.items():
                seen.add(("top", k))
                types["top", k][kind(v)] += 1
            for e in es:
                for k, v in e.items():
                    seen.add(("element", "element." + k))
                    types["element", "element." + k][None if k == value_key else kind(v)] += 1
                if e.get(metric_key) is not None:
                    m = ("metric", "metric." + path(e[metric_key]))
                    seen.add(m)
                    types[m][kind(e.get(value_key))] += 1
            held.update(seen)
        schemas[f] = {k: types[k] for k in held if held[k] * 2 > len(recs)}
    out = set()
    for feed in {f for f, _ in schemas}:
        known, before = {}, None
        for no in sorted(n for f, n in schemas if f == feed):
            now = schemas[feed, no]
            typed = {}
            for k, c in now.items():
                c = {t: n for t, n in c.items() if t}
                top = [t for t in drift.TYPES if c.get(t, 0) == max(c.values())] if c else []
                typed[k] = known.get(k) if known.get(k) in top or not top else top[0]
            if before is not None:
                for level in ("top", "element", "metric"):
                    gone = {k for k in before if k[0] == level} - set(now)
                    new = {k for k in now if k[0] == level} - set(before)
                    if len(gone) == len(new) == 1:
                        out.add((feed, no, "renamed", new.pop()[1]))
                    else:
                        assert not (gone and new), "ambiguous"
                        out |= {(feed, no, "removed", k[1]) for k in gone} | {(feed, no, "added", k[1]) for k in new}
                out |= {(feed, no, "retyped", k[1]) for k in now if k in before and known.get(k) and typed[k] != known[k]}
            known |= {k: t for k, t in typed.items() if t}
            before = now
    return out


def found(raw):
    return {(r.feed, r.file_no, r.change_kind, r.field_name) for r in drift.changes(drift.fields(raw)).collect()}


def test_matches_brute_force(spark, data):
    raw = table(spark, data.replace("0.001", "0.01"), "raw_collections")
    rows = [(r.feed, r.file_no, r.line_no, r.body) for r in raw.collect()]
    assert found(raw) == brute(rows)


def rec(tp=1, elements=None, **more):
    return json.dumps({"tp": tp, "elements": [{"group": "g", "metric": "a.b", "value": 1.5}, {"group": "g", "metric": "c.d", "value": 2}] if elements is None else elements, **more})


def raw_of(spark, *files):
    return spark.createDataFrame([("f", no, f"f/{no}", i, None, b) for no, lines in files for i, b in enumerate(lines)], SCHEMA)


def test_types_of_nulls_go_on_and_pairs_become_renames(spark):
    raw = raw_of(
        spark,
        (1, [rec(x=1, y="s"), rec(x=2, y="t"), None, "", "{broken"]),
        (3, [rec(x=None, z="s"), rec(x=None, z="t")]),
        (4, [rec(x="1", z="s"), rec(x="2", z="s"), rec(x=3, z="s"), rec(x=3, z="s") + " "]),
        (5, [rec(z="s", p=1, q=1), rec(z="s", p=1, q=1)]),
    )
    got = found(raw)
    assert ("f", 3, "renamed", "z") in got and not any(k == "retyped" and n == 3 for _, n, k, _ in got)
    assert sorted(k for _, n, k, _ in got if n == 5) == ["added", "renamed"]


def test_exactly_half_is_not_held_and_text_elements_are_read_on(spark):
    inner = [{"group": "g", "metric": ["a", "b"], "value": 1}, {"group": "g", "metric": ["c"], "value": True}]
    raw = raw_of(spark, (1, [rec(h=1), rec()]), (2, [rec(elements=json.dumps(inner)), rec(elements=json.dumps(inner))]))
    got = found(raw)
    assert not any(f == "h" for *_, f in got)
    assert ("f", 2, "retyped", "elements") in got and ("f", 2, "retyped", "element.metric") in got and ("f", 2, "renamed", "metric.c") in got


def test_readings_keep_every_alternative_and_convert(spark):
    values = [1.5, True, "~7.25 ms", None, {"n": 3.5, "u": "a"}, [[0, 10, 4], [10, 50, 3]], "none"]
    es = [{"group": "g", "metric": f"m{i}", "value": v} for i, v in enumerate(values)]
    rows = {r.metric: r for r in drift.readings(raw_of(spark, (1, [rec(elements=es)]))).collect()}
    assert [rows[f"m{i}"].v_canonical for i in range(7)] == [1.5, 1.0, 7.25, None, 3.5, 7.0, None]
    assert [rows[f"m{i}"].alternative for i in range(7)] == ["number", "boolean", "string", None, "object", "list", "string"]
    assert json.loads(rows["m4"].v_object) == {"n": 3.5, "u": "a"}


def test_empty(spark):
    raw = spark.createDataFrame([], SCHEMA)
    assert found(raw) == set() and drift.readings(raw).count() == 0
