"""Samples of native history files by columns: Arrow batches to files and back, without a Python object per sample.

All that a file holds is a whole number of words of four bytes, so a file is put together from, and taken apart into, arrays of words; paths and tags are numbered.
"""

import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tsq.sources import native as nt

#: Rows of a batch that is read.
BATCH = 10_000


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u4").astype(np.uint32)


def _bytes(words: np.ndarray) -> bytes:
    return words.astype(">u4").tobytes()


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.repeat(starts - _starts(lengths), lengths) + np.arange(lengths.sum())


def _halves(v: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits as two words each, the high one first."""
    u = np.ascontiguousarray(v).view(np.uint64)
    return np.stack([u >> np.uint64(32), u & np.uint64(0xFFFFFFFF)], axis=-1).astype(np.uint32)


def _whole(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


class _Ragged:
    """Pieces of words by number."""

    def __init__(self, pieces: list[np.ndarray]):
        self.n = np.array([len(p) for p in pieces], np.int64)
        self.at = _starts(self.n)
        self.words = np.concatenate([*pieces, np.empty(0, np.uint32)]).astype(np.uint32)

    def put(self, out: np.ndarray, at: np.ndarray, which: np.ndarray) -> None:
        n = self.n[which]
        out[_spans(at, n)] = self.words[_spans(self.at[which], n)]


def _coded(f) -> np.ndarray:
    o = nt._Out()
    f(o)
    return _words(bytes(o.data))


def text(s: str) -> np.ndarray:
    return _coded(lambda o: o.text(s))


def _put_tags(o: "nt._Out", tags: tuple) -> None:
    o.many(tags, lambda t: (o.text(t[0]), o.value(t[1])))


# --- from Arrow ---


def _value_words(v: pa.Array, texts) -> tuple[np.ndarray, np.ndarray]:
    """Values as words, one after the other, and how many each has. texts: words of a string."""
    if v.null_count:
        raise nt.FormatError("an absent value can't be written")
    kind, b, i, u, d, s, h = v.flatten()
    if kind.null_count:
        raise nt.FormatError("a value without a kind")
    k = kind.to_numpy()
    there = lambda x: np.asarray(x.is_valid())
    whole = (k == 2) | (k == 3)
    isb, isi, isd, iss, ish = (k == 1) & there(b), whole & there(i), (k == 4) & there(d), (k == 5) & there(s), (k == 6) & there(h)
    isu = whole & ~isi & there(u)
    code, n = np.full(len(k), nt.EMPTY, np.uint32), np.ones(len(k), np.int64)
    for rows, c, length in ((isb, nt.BOOL, 2), (isi, nt.INT, 3), (isd | isu, nt.FLOAT, 3)):
        code[rows], n[rows] = c, length
    code[iss], code[ish] = nt.STRING, nt.HISTOGRAM
    named = s.filter(pa.array(iss)).dictionary_encode()
    pieces, which = _Ragged([texts(x) for x in named.dictionary.to_pylist()]), named.indices.to_numpy()
    n[iss] = 1 + pieces.n[which]
    h = h.filter(pa.array(ish))
    ranges = h.value_lengths().to_numpy()
    n[ish] = 2 + 6 * ranges.astype(np.int64)
    at = _starts(n)
    out = np.empty(n.sum(), np.uint32)
    out[at] = code
    out[at[isb] + 1] = np.asarray(b.filter(pa.array(isb)))
    for rows, x in ((isi, i.filter(pa.array(isi)).to_numpy()), (isd, d.filter(pa.array(isd)).to_numpy()), (isu, np.array([float(x) for x in u.filter(pa.array(isu)).to_pylist()]))):
        p, w = at[rows], _halves(x)
        out[p + 1], out[p + 2] = w[:, 0], w[:, 1]
    pieces.put(out, at[iss] + 1, which)
    out[at[ish] + 1] = ranges
    if len(h):
        bounds = np.stack([x.to_numpy(zero_copy_only=False) for x in h.flatten().flatten()], axis=-1)
        out[_spans(at[ish] + 2, 6 * ranges.astype(np.int64))] = _halves(bounds).ravel()
    return out, n


def _fixed(codes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(8), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes, np.int64))]).cast(pa.binary())


def _numbers(column: pa.Array, codes: np.ndarray, number) -> np.ndarray:
    """Numbers of lists, whose elements have codes. number: of a list as a Python one; it is asked once for each that differs."""
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).astype(np.int32)
    keys = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), _fixed(codes)), b"")
    places = keys.dictionary_encode().indices.to_numpy()
    _, first = np.unique(places, return_index=True)
    return np.array([number(x) for x in column.take(pa.array(first)).to_pylist()], np.int64)[places] if len(places) else np.empty(0, np.int64)


def _path_codes(column: pa.Array) -> np.ndarray:
    parts = column.flatten()
    if column.null_count or parts.null_count:
        raise nt.FormatError("a path or a part of it is missing")
    return parts.dictionary_encode().indices.to_numpy()


def _tag_codes(column: pa.Array) -> np.ndarray:
    keys, values = column.flatten().flatten()
    if keys.null_count:
        raise nt.FormatError("a tag without a key")
    words, n = _value_words(values, text)
    offsets = np.concatenate([[0], 4 * np.cumsum(n)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(words)]).dictionary_encode()
    return keys.dictionary_encode().indices.to_numpy().astype(np.int64) << 32 | coded.indices.to_numpy()


class _Tags:
    """Numbers of tags; true and 1 are different ones."""

    def __init__(self) -> None:
        self.items: list[tuple] = []
        self.index: dict = {}

    def __call__(self, tags: tuple) -> int:
        key = tuple((k, isinstance(v, bool), v) for k, v in tags)
        if key not in self.index:
            self.index[key] = len(self.items)
            self.items.append(tags)
        return self.index[key]


@dataclass
class Samples:
    """The samples of a file, by time, path, tags and metric. words: those of the values; the values have n each, from at on."""

    t: np.ndarray
    path: np.ndarray
    tags: np.ndarray
    metric: np.ndarray
    words: np.ndarray
    at: np.ndarray
    n: np.ndarray
    paths: list[tuple]
    tagged: list[tuple]
    #: None if the strings of values are written out.
    strings: "nt._Table | None"

    def begins(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a scrape, a path in it, and a group in it begin."""
        changed = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
        scrape = changed(self.t)
        path = scrape | changed(self.path)
        return scrape, path, path | changed(self.tags)

    def scrapes(self) -> Iterator["nt.Scrape"]:
        """The same as Python objects."""
        values = [None] * len(self.t)
        i = nt._In(_bytes(self.words))
        for k, at in enumerate((4 * self.at).tolist()):
            i.at = at
            values[k] = i.value(None if self.strings is None else lambda: self.strings.at(i.u32()))
        groups: dict = {}
        now = None
        for t, p, g, m, v in zip(self.t.tolist(), self.path.tolist(), self.tags.tolist(), self.metric.tolist(), values):
            if t != now and groups:
                yield now, groups
                groups = {}
            now = t
            groups.setdefault((self.paths[p], self.tagged[g]), {})[self.paths[m]] = v
        if groups:
            yield now, groups


def collect(batches, texts: bool, latest: str | None = None) -> Samples | None:
    """Of equal series and times the later sample counts, or that with the greatest number in the column latest. texts: strings of values are written out (version 0); else numbered."""
    paths, tagged, strings = nt._Table(), _Tags(), nt._Table()
    path = lambda x: paths(tuple(x))
    tags = lambda x: tagged(tuple(sorted((t["k"], nt._plain(t["v"])) for t in x or [])))
    parts: list[tuple] = []
    for b in batches:
        if not b.num_rows:
            continue
        t, grp, tg, metric, value = (b.column(b.schema.get_field_index(c)) for c in ("tp_ms", "grp", "tags", "metric", "value"))
        if t.null_count:
            raise nt.FormatError("a sample without a time")
        words, n = _value_words(value, text if texts else lambda s: np.array([strings(s)], np.uint32))
        # numbers that are missing come first
        seq = b.column(b.schema.get_field_index(latest)).fill_null(-(1 << 63)).to_numpy() if latest else np.zeros(b.num_rows, np.int64)
        parts.append((t.to_numpy(), _numbers(grp, _path_codes(grp), path), _numbers(tg, _tag_codes(tg), tags), _numbers(metric, _path_codes(metric), path), seq, n, words))
    if not parts:
        return None
    t, p, g, m, seq, n, words = (np.concatenate(x) for x in zip(*parts))
    at = _starts(n)
    order = np.lexsort((seq, m, g, p, t))
    t, p, g, m = (x[order] for x in (t, p, g, m))
    last = np.concatenate([(t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (g[1:] != g[:-1]) | (m[1:] != m[:-1]), [True]])
    order = order[last]
    return Samples(t[last], p[last], g[last], m[last], words, at[order], n[order], paths.items, tagged.items, None if texts else strings)


# --- files ---


def encode0(s: Samples) -> bytes:
    """A whole file of version 0."""
    scrape, path, group = s.begins()
    names, tags = _Ragged([_coded(lambda o: o.path(x)) for x in s.paths]), _Ragged([_coded(lambda o: _put_tags(o, x)) for x in s.tagged])
    size = 3 * scrape + path * (names.n[s.path] + 1) + group * (tags.n[s.tags] + 1) + names.n[s.metric] + s.n
    at = _starts(size)
    out = np.empty(size.sum(), np.uint32)
    counts = lambda inner, outer: np.add.reduceat(inner.astype(np.int64), np.flatnonzero(outer))
    p = at[scrape]
    times = _halves(s.t[scrape])
    out[p], out[p + 1], out[p + 2] = times[:, 0], times[:, 1], counts(path, scrape)
    at = at + 3 * scrape
    for begins, pieces, which, n in ((path, names, s.path, lambda: counts(group, path)), (group, tags, s.tags, lambda: counts(np.ones(len(s.t)), group))):
        p, w = at[begins], which[begins]
        pieces.put(out, p, w)
        out[p + pieces.n[w]] = n()
        at = at + begins * (pieces.n[which] + 1)
    names.put(out, at, s.metric)
    out[_spans(at + names.n[s.metric], s.n)] = s.words[_spans(s.at, s.n)]
    return nt._mime(0) + _bytes(_halves(s.t[[0, -1]]).ravel()) + _bytes(out)


def encode2(s: Samples) -> bytes:
    """A whole file of version 2 (list), not packed. The first scrape's update has all entries of the dictionaries."""
    d = nt._Tables2()
    d.strings = s.strings
    for x in s.paths:
        d.paths(x)
    d.tags.items = s.tagged
    head = bytearray(nt.MIME + nt.HEADER2 + 4)
    flags = nt.SORTED | nt.DISTINCT | nt.KIND_LIST
    update = nt._add_segment(head, d.update(), flags)
    scrape, path, group = s.begins()
    sample_of = lambda x: np.flatnonzero(x)
    # of each group the words of its metrics, of each scrape those of its groups' segments, its records and its link, without checksums
    metrics = 1 + np.add.reduceat(1 + s.n, sample_of(group))
    of_group = np.cumsum(scrape)[group] - 1
    firsts = np.flatnonzero(scrape[group])
    groups, paths = np.diff(np.append(firsts, len(metrics))), np.add.reduceat(path.astype(np.int64), sample_of(scrape))
    segments, records, link = np.add.reduceat(metrics + 1, firsts), 1 + 2 * paths + 5 * groups, 13
    size = segments + records + 1 + link + 1
    base = len(head) // 4
    begin = base + _starts(size)
    out = np.empty(size.sum() + base, np.uint32)
    out[:base] = _words(bytes(head))
    at_metrics = _starts(metrics + 1)
    at_metrics += (begin - at_metrics[firsts])[of_group]
    at_records = begin + segments
    at_link = at_records + records + 1

    def pointer(at: np.ndarray, to: np.ndarray, n: np.ndarray) -> None:
        for k, w in enumerate((*_halves(4 * to).T, *_halves(4 * n).T)):
            out[at + k] = w

    # metrics
    in_group = np.cumsum(group) - 1
    out[at_metrics] = np.diff(np.append(sample_of(group), len(s.t)))
    before = _starts(1 + s.n)
    at = at_metrics[in_group] + 1 + before - before[group][in_group]
    out[at] = s.metric
    out[_spans(at + 1, s.n)] = s.words[_spans(s.at, s.n)]
    # records
    out[at_records] = paths
    of_path = path[group]
    at = at_records[of_group] + 1
    k = np.arange(len(metrics))
    rank = np.cumsum(of_path)
    at = at + 5 * (k - firsts[of_group]) + 2 * (rank - rank[firsts][of_group] + 1)
    p = at[of_path] - 2
    out[p], out[p + 1] = s.path[path], np.diff(np.append(np.flatnonzero(of_path), len(metrics)))
    out[at] = s.tags[group]
    pointer(at + 1, at_metrics, metrics)
    # links: time, the link before (not of the first), the update (of the first), records, and a word that is 0
    times = _halves(s.t[scrape])
    out[at_link], out[at_link + 1] = times[:, 0], times[:, 1]
    out[at_link[0] + 2 : at_link[0] + 4] = 0, 1
    pointer(at_link[:1] + 4, np.array([update[0] // 4]), np.array([0]))
    out[at_link[0] + 6 : at_link[0] + 8] = update[1] >> 32, update[1] & 0xFFFFFFFF
    out[at_link[1:] + 2], out[at_link[1:] + 7] = 1, 0
    pointer(at_link[1:] + 3, at_link[:-1], np.full(len(at_link) - 1, link))
    pointer(at_link + 8, at_records, records)
    out[at_link + 12] = 0
    # checksums
    starts, ends = np.concatenate([at_metrics, at_records, at_link]), np.concatenate([at_metrics + metrics, at_records + records, at_link + link])
    out[ends] = 0
    data = bytearray(_bytes(out))
    view = memoryview(data)
    sums = [zlib.crc32(view[a:b]) for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
    np.frombuffer(data, ">u4")[ends] = sums
    view.release()
    data[: nt.MIME + nt.HEADER2 + 4] = nt._header2(int(s.t[0]), int(s.t[-1]), flags, len(data), (4 * int(at_link[-1]), 4 * link))
    return bytes(data)


class _Read:
    """What is read of a file: its words; per group its scrape, path, tags and number of metrics; per sample its metric and where its value begins."""

    def __init__(self, data: bytes):
        if len(data) % 4:
            raise nt.FormatError("the file ends too early")
        self.w = array("I", data)
        if sys.byteorder == "little":
            self.w.byteswap()
        self.data = data
        self.times: list[int] = []
        self.scrape, self.path, self.tags, self.count, self.metric, self.at = (array("q") for _ in range(6))
        self.paths, self.tagged = nt._Table(), _Tags()
        self.texts: list[str] | None = None

    def skip(self, p: int) -> int:
        """Where the value at p ends."""
        w = self.w
        k = w[p]
        if k == nt.INT or k == nt.FLOAT:
            return p + 3
        if k == nt.STRING:
            return p + 2 if self.texts is not None else p + 2 + (w[p + 1] + 3 >> 2)
        if k == nt.HISTOGRAM:
            return p + 2 + 6 * w[p + 1]
        if k == nt.BOOL:
            return p + 2
        if k == nt.EMPTY:
            return p + 1
        raise nt.FormatError(f"value of kind {k}")

    def batches(self, schema: pa.Schema, begin: int | None, end: int | None) -> Iterator[pa.RecordBatch]:
        count = np.array(self.count, np.int64)
        scrape, path, tags = (np.repeat(np.array(x, np.int64), count) for x in (self.scrape, self.path, self.tags))
        metric, at = np.array(self.metric, np.int64), np.array(self.at, np.int64)
        t = np.array(self.times, np.int64)[scrape] if self.times else np.empty(0, np.int64)
        order = np.lexsort((metric, tags, path, scrape))
        same = np.ones(max(0, len(order) - 1), bool)
        for x in (scrape, path, tags, metric):
            same &= x[order[1:]] == x[order[:-1]]
        if same.any():  # of equal series in a scrape the last counts
            order = np.sort(order[np.append(~same, True)])
        else:
            order = np.arange(len(t))
        if begin is not None:
            order = order[t[order] >= begin]
        if end is not None:
            order = order[t[order] <= end]
        words = np.frombuffer(self.w, np.uint32)
        kinds = {name: schema.field(name).type for name in schema.names}
        paths = pa.array([list(p) for p in self.paths.items], kinds["grp"])
        tagged = pa.array([[{"k": k, "v": dict(zip(("kind", "b", "i", "u", "d", "s", "h"), nt._mv(v)))} for k, v in g] for g in self.tagged.items], kinds["tags"])
        for k in range(0, len(order), BATCH):
            o = order[k : k + BATCH]
            made = {"tp_ms": pa.array(t[o]), "grp": paths.take(pa.array(path[o])), "tags": tagged.take(pa.array(tags[o])), "metric": paths.take(pa.array(metric[o])), "value": self.values(words, at[o], kinds["value"])}
            yield pa.RecordBatch.from_arrays([made[name] for name in schema.names], schema=schema)

    def values(self, w: np.ndarray, at: np.ndarray, kind: pa.StructType) -> pa.Array:
        k = w[at]
        isi, isd, isb, iss, ish = (k == x for x in (nt.INT, nt.FLOAT, nt.BOOL, nt.STRING, nt.HISTOGRAM))
        eight = np.zeros(len(at), np.uint64)
        p = at[isi | isd]
        eight[isi | isd] = _whole(w[p + 1], w[p + 2])
        i = eight.view(np.int64)
        b = np.zeros(len(at), bool)
        b[isb] = w[at[isb] + 1] != 0
        mv = np.select([isi & (i < 0), isi, isd, isb, iss, ish], [2, 3, 4, 1, 5, 6], 0).astype(np.int8)
        which = np.zeros(len(at), np.int64)
        which[iss] = np.arange(iss.sum())
        texts = pa.array([self.text(x + 1) for x in at[iss].tolist()], pa.string()).take(pa.array(which, mask=~iss))
        n = np.zeros(len(at), np.int64)
        n[ish] = w[at[ish] + 1]
        bounds = w[_spans(at + 2, 6 * n)]
        bounds = _whole(bounds[::2], bounds[1::2]).view(np.float64).reshape(-1, 3)
        h = kind.field("h").type
        ranges = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in bounds.T], fields=[h.value_type.field(x) for x in range(3)])
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        columns = [
            pa.array(mv),
            pa.array(b, mask=~isb),
            pa.array(i, mask=~isi),
            pa.nulls(len(at), kind.field("u").type),
            pa.array(eight.view(np.float64), mask=~isd, from_pandas=False),
            texts,
            pa.ListArray.from_arrays(pa.array(offsets), ranges, type=h, mask=pa.array(~ish)),
        ]
        return pa.StructArray.from_arrays(columns, fields=[kind.field(x) for x in range(7)])

    def text(self, p: int) -> str:
        if self.texts is not None:
            if self.w[p] >= len(self.texts):
                raise nt.FormatError("an entry is missing from a dictionary")
            return self.texts[self.w[p]]
        return self.data[4 * p + 4 : 4 * p + 4 + self.w[p]].decode()


def read0(data: bytes) -> _Read:
    r = _Read(data)
    w, skip = r.w, r.skip
    names: dict[bytes, int] = {}
    tagsets: dict[bytes, int] = {}

    def name(s: int, p: int) -> int:
        key = data[4 * s : 4 * p]
        if key not in names:
            names[key] = r.paths(nt._In(key).path())
        return names[key]

    def tags(s: int, p: int) -> int:
        key = data[4 * s : 4 * p]
        if key not in tagsets:
            i = nt._In(key)
            tagsets[key] = r.tagged(tuple(sorted(i.many(lambda: (i.text(), i.value())))))
        return tagsets[key]

    p, n = (nt.MIME + 16) // 4, len(w)
    try:
        while p < n:
            t = w[p] << 32 | w[p + 1]
            scrape = len(r.times)
            r.times.append(t - (t >> 63 << 64))
            paths = w[p + 2]
            p += 3
            for _ in range(paths):
                s = p
                p += 1
                for _ in range(w[s]):
                    p += 1 + (w[p] + 3 >> 2)
                path = name(s, p)
                groups = w[p]
                p += 1
                for _ in range(groups):
                    s = p
                    p += 1
                    for _ in range(w[s]):
                        p = skip(p + 1 + (w[p] + 3 >> 2))
                    r.scrape.append(scrape)
                    r.path.append(path)
                    r.tags.append(tags(s, p))
                    metrics = w[p]
                    r.count.append(metrics)
                    p += 1
                    for _ in range(metrics):
                        s = p
                        p += 1
                        for _ in range(w[s]):
                            p += 1 + (w[p] + 3 >> 2)
                        key = data[4 * s : 4 * p]
                        r.metric.append(names[key] if key in names else name(s, p))
                        r.at.append(p)
                        p = skip(p)
    except IndexError:
        raise nt.FormatError("the file ends too early") from None
    if p != n:
        raise nt.FormatError("the file ends too early")
    return r


def read2(data: bytes, flags: int, pointer: tuple[int, int]) -> _Read:
    """A list whose segments aren't packed."""
    # what lies after the last whole word belongs to no segment
    r = _Read(data[: len(data) - len(data) % 4])
    w, skip, crc, view = r.w, r.skip, zlib.crc32, memoryview(data)

    def segment(p: int) -> tuple[int, int]:
        """Where the segment begins and ends to which the pointer at p points."""
        return checked(w[p] << 32 | w[p + 1], w[p + 2] << 32 | w[p + 3])

    def checked(at: int, n: int) -> tuple[int, int]:
        end = at + n + 3 & ~3
        if at % 4 or end >= len(data) or crc(view[at:end]) != w[end >> 2]:
            raise nt.FormatError("a segment's checksum differs")
        return at >> 2, end >> 2

    try:
        chain: list[tuple[int, int, int]] = []
        updates = []
        while pointer != (0, 0):
            s, _ = checked(*pointer)
            t = w[s] << 32 | w[s + 1]
            p = s + 3
            pointer = (0, 0)
            if w[s + 2]:
                pointer = (w[p] << 32 | w[p + 1], w[p + 2] << 32 | w[p + 3])
                p += 4
            p += 1
            if w[p - 1]:
                updates.append((w[p] << 32 | w[p + 1], w[p + 2] << 32 | w[p + 3]))
                p += 4
            chain.append((t - (t >> 63 << 64), p))
        d = nt._Tables2()
        for u in reversed(updates):
            d.read(nt._segment(data, u, flags))
        r.texts = d.strings.items
        names, tagsets = [r.paths(x) for x in d.paths.items], [r.tagged(x) for x in d.tags.items]
        for t, p in reversed(chain):
            scrape = len(r.times)
            r.times.append(t)
            p, _ = segment(p)
            paths = w[p]
            p += 1
            for _ in range(paths):
                path, groups = names[w[p]], w[p + 1]
                p += 2
                for _ in range(groups):
                    r.scrape.append(scrape)
                    r.path.append(path)
                    r.tags.append(tagsets[w[p]])
                    q, end = segment(p + 1)
                    p += 5
                    metrics = w[q]
                    r.count.append(metrics)
                    q += 1
                    for _ in range(metrics):
                        r.metric.append(names[w[q]])
                        r.at.append(q + 1)
                        q = skip(q + 1)
                    if q > end:
                        raise nt.FormatError("the file ends too early")
    except IndexError:
        raise nt.FormatError("the file ends too early, or an entry is missing from a dictionary") from None
    return r


def read_batches(path: str, schema: pa.Schema, begin: int | None, end: int | None) -> Iterator[pa.RecordBatch] | None:
    """The samples of a file within begin..end, if it is of version 0 or an unpacked list of version 2; else None."""
    data = nt._load(path)
    version = nt.head(data)
    if version == 0:
        return read0(data).batches(schema, begin, end)
    if version == 2:
        _, _, flags, pointer = nt._open2(data)
        if flags & nt.KIND_MASK != nt.KIND_TABLES and not flags & nt.COMPRESSION_MASK:
            return read2(data, flags, pointer).batches(schema, begin, end)
    return None
