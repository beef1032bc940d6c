"""Native history files: format versions 0, 1 and 2 (list and tables), as a Spark data source that reads and writes samples.

A file is a sequence of scrapes in XDR (big-endian words of four bytes). Versions 0 and 1 may be gzipped as a whole; version 2 consists of
segments with a checksum, each maybe gzipped. Files lie in a folder that all executors see.
"""

import gzip
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tsq.schema import SAMPLES_DDL

#: The magic, the kinds of values, and the flags of version 2.
MAGIC = bytes.fromhex("11 13 17 1d 4d 4f 4e 2d 73 6f 6f 6e")
BOOL, INT, FLOAT, STRING, HISTOGRAM, EMPTY = 0, 1, 2, 3, 4, 0x7FFFFFFF
KIND_MASK, KIND_LIST, KIND_TABLES = 0x0000000F, 0, 1
COMPRESSION_MASK, GZIP = 0x3F000000, 0x20000000
SORTED, DISTINCT = 0x40000000, 0x80000000
#: Length of the magic with the version; of the header of version 2; the longest run of a bitset; the longest step between times of a block.
MIME, HEADER2, RUN, STEP = 16, 48, 0x7FFF, 0x7FFFFFFF

#: A scrape: its time, and per group (path, tags) the metrics and their values. Paths are tuples, tags sorted tuples of (key, value); values are Python constants, None for empty.
Scrape = tuple[int, dict[tuple, dict[tuple, object]]]


class FormatError(ValueError):
    pass


class _In:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str, n: int):
        if self.at + n > len(self.data):
            raise FormatError("the file ends too early")
        (v,) = struct.unpack_from(form, self.data, self.at)
        self.at += n
        return v

    def u32(self) -> int:
        return self.take(">I", 4)

    def i32(self) -> int:
        return self.take(">i", 4)

    def i64(self) -> int:
        return self.take(">q", 8)

    def u64(self) -> int:
        return self.take(">Q", 8)

    def f64(self) -> float:
        return self.take(">d", 8)

    def flag(self) -> bool:
        return bool(self.u32())

    def text(self) -> str:
        n = self.u32()
        if self.at + n > len(self.data):
            raise FormatError("the file ends too early")
        s = self.data[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return s

    def many(self, f) -> list:
        return [f() for _ in range(self.u32())]

    def path(self) -> tuple:
        return tuple(self.many(self.text))

    def pointer(self) -> tuple[int, int]:
        return self.u64(), self.u64()

    def histogram(self) -> tuple:
        return tuple(self.many(lambda: (self.f64(), self.f64(), self.f64())))

    def value(self, text=None):
        """text: how a string is read; by itself unless a dictionary has it."""
        k = self.u32()
        read = {BOOL: self.flag, INT: self.i64, FLOAT: self.f64, STRING: text or self.text, HISTOGRAM: self.histogram, EMPTY: lambda: None}
        if k not in read:
            raise FormatError(f"value of kind {k}")
        return read[k]()

    def bits(self) -> list[bool]:
        out: list[bool] = []
        for i, n in enumerate(self.many(self.u32)):
            out += [i % 2 == 0] * n
        return out

    def places(self) -> list[int]:
        """Where a bitset's bits are set."""
        out: list[int] = []
        at = 0
        for i, n in enumerate(self.many(self.u32)):
            if i % 2 == 0:
                out += range(at, at + n)
            at += n
        return out

    def end(self) -> bool:
        return self.at >= len(self.data)


class _Out:
    def __init__(self) -> None:
        self.data = bytearray()

    def put(self, form: str, v) -> "_Out":
        self.data += struct.pack(form, v)
        return self

    def u32(self, v: int) -> "_Out":
        return self.put(">I", v)

    def text(self, s: str) -> None:
        b = s.encode()
        self.u32(len(b)).data.extend(b + bytes(-len(b) % 4))

    def many(self, items, f) -> None:
        items = list(items)
        self.u32(len(items))
        for x in items:
            f(x)

    def path(self, p) -> None:
        self.many(p, self.text)

    def pointer(self, p: tuple[int, int]) -> None:
        self.put(">Q", p[0]).put(">Q", p[1])

    def value(self, v, text=None) -> None:
        if v is None:
            self.u32(EMPTY)
        elif isinstance(v, bool):
            self.u32(BOOL).u32(v)
        elif isinstance(v, int) and -(1 << 63) <= v < 1 << 63:
            self.u32(INT).put(">q", v)
        elif isinstance(v, (int, float)):
            self.u32(FLOAT).put(">d", float(v))
        elif isinstance(v, str):
            self.u32(STRING)
            (text or self.text)(v)
        else:
            self.u32(HISTOGRAM)
            self.many(v, lambda r: [self.put(">d", float(x)) for x in r])

    def bits(self, bits: list[bool]) -> None:
        self.places([at for at, there in enumerate(bits) if there], len(bits))

    def places(self, places: list[int], n: int) -> None:
        """A bitset of n bits, of which those at the (sorted) places are set. What it costs depends on their number, not on n."""
        runs: list[int] = []
        current, at, k = True, 0, 0
        while at < n:
            if current:
                first = k
                while k < len(places) and places[k] == at + k - first:
                    k += 1
                count = k - first
            else:
                count = (places[k] if k < len(places) else n) - at
            at += count
            while count > RUN:
                runs += [RUN, 0]
                count -= RUN
            runs.append(count)
            current = not current
        self.data += struct.pack(f">{len(runs) + 1}I", len(runs), *runs)


class _Table:
    """A dictionary that grows: index by entry, and where the next update begins."""

    def __init__(self) -> None:
        self.items: list = []
        self.index: dict = {}
        self.start = 0

    def __call__(self, x) -> int:
        if x not in self.index:
            self.index[x] = len(self.items)
            self.items.append(x)
        return self.index[x]

    def pending(self) -> list:
        out = self.items[self.start :]
        self.start = len(self.items)
        return out

    def at(self, i: int):
        if i >= len(self.items):
            raise FormatError("an entry is missing from a dictionary")
        return self.items[i]


def _mime(version: int) -> bytes:
    return MAGIC + struct.pack(">I", version << 16)


def head(data: bytes) -> int:
    """Version of a file from its first bytes; FormatError if it isn't one."""
    if data[:12] != MAGIC or len(data) < MIME:
        raise FormatError("no magic")
    (v,) = struct.unpack_from(">I", data, 12)
    return v >> 16


def _load(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read()
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def is_history(path: str) -> bool:
    """Whether a regular file is one of these, by its head."""
    if not os.path.isfile(path):
        return False
    try:
        with open(path, "rb") as f:
            data = f.read(2)
            f.seek(0)
            data = gzip.GzipFile(fileobj=f).read(MIME) if data == b"\x1f\x8b" else f.read(MIME)
        return head(data) in (0, 1, 2)
    except (OSError, EOFError, FormatError, zlib.error):
        return False


def bounds(path: str) -> tuple[int, int]:
    """First and last time of a file, from its header."""
    with open(path, "rb") as f:
        data = f.read(2)
        f.seek(0)
        data = gzip.GzipFile(fileobj=f).read(MIME + 16) if data == b"\x1f\x8b" else f.read(MIME + 16)
    head(data)
    i = _In(data, MIME)
    return i.i64(), i.i64()


# --- versions 0 and 1 ---


def _read0(i: _In) -> Iterator[Scrape]:
    while not i.end():
        t = i.i64()
        groups: dict = {}
        for _ in range(i.u32()):
            path = i.path()
            for _ in range(i.u32()):
                tags = tuple(sorted(i.many(lambda: (i.text(), i.value()))))
                groups.setdefault((path, tags), {}).update(i.many(lambda: (i.path(), i.value())))
        yield t, groups


def _write0(o: _Out, s: Scrape) -> None:
    o.put(">q", s[0])
    paths: dict = {}
    for (path, tags), metrics in s[1].items():
        paths.setdefault(path, []).append((tags, metrics))

    def tagged(x) -> None:
        o.many(x[0], lambda t: (o.text(t[0]), o.value(t[1])))
        o.many(x[1].items(), lambda m: (o.path(m[0]), o.value(m[1])))

    o.many(paths.items(), lambda p: (o.path(p[0]), o.many(p[1], tagged)))


class _Tables1:
    """The dictionaries of a version 1 file: strings, groups, metrics, tags."""

    def __init__(self) -> None:
        self.strings, self.groups, self.metrics, self.tags = _Table(), _Table(), _Table(), _Table()

    def read(self, i: _In) -> None:
        string = lambda: self.strings.at(i.u32())
        tags = lambda: tuple(sorted(i.many(lambda: (i.text(), i.value(string)))))
        for table, one in ((self.strings, i.text), (self.groups, i.path), (self.metrics, i.path), (self.tags, tags)):
            for _ in range(i.u32()):
                k = i.u32()
                if k != len(table.items):
                    raise FormatError("updates of a dictionary must follow each other")
                table(one())
            table.start = len(table.items)

    def update(self) -> bytes | None:
        if all(t.start == len(t.items) for t in (self.strings, self.groups, self.metrics, self.tags)):
            return None
        last, o = _Out(), _Out()

        def put(o: _Out, table: _Table, one) -> None:
            first = table.start
            o.many(enumerate(table.pending(), first), lambda x: (o.u32(x[0]), one(x[1])))

        # tags may add strings, so they are encoded first and written last
        put(last, self.tags, lambda t: last.many(t, lambda x: (last.text(x[0]), last.value(x[1], lambda s: last.u32(self.strings(s))))))
        put(o, self.strings, o.text)
        put(o, self.groups, o.path)
        put(o, self.metrics, o.path)
        return bytes(o.data + last.data)


def _read1(i: _In, d: _Tables1 | None = None) -> Iterator[Scrape]:
    d = d or _Tables1()
    while not i.end():
        t = i.i64()
        if i.flag():
            d.read(i)
        string = lambda: d.strings.at(i.u32())
        groups: dict = {}
        for _ in range(i.u32()):
            key = d.groups.at(i.u32()), d.tags.at(i.u32())
            groups.setdefault(key, {}).update(i.many(lambda: (d.metrics.at(i.u32()), i.value(string))))
        yield t, groups


def _write1(o: _Out, s: Scrape, d: _Tables1) -> None:
    body = _Out()

    def group(x) -> None:
        body.u32(d.groups(x[0][0])).u32(d.tags(x[0][1]))
        body.many(x[1].items(), lambda m: (body.u32(d.metrics(m[0])), body.value(m[1], lambda t: body.u32(d.strings(t)))))

    body.many(s[1].items(), group)
    update = d.update()
    o.put(">q", s[0]).u32(update is not None)
    o.data += (update or b"") + body.data


# --- version 2 ---


class _Tables2:
    """The dictionaries of version 2: strings, paths and tags, the latter two of string numbers."""

    def __init__(self) -> None:
        self.strings, self.paths, self.tags = _Table(), _Table(), _Table()

    def read(self, i: _In) -> None:
        string = lambda: self.strings.at(i.u32())

        def tags() -> tuple:
            keys, values = i.many(string), i.many(lambda: i.value(string))
            if len(keys) != len(values):
                raise FormatError("tags without values")
            return tuple(sorted(zip(keys, values)))

        for table, one in ((self.strings, i.text), (self.paths, lambda: tuple(i.many(string))), (self.tags, tags)):
            if i.u32() != len(table.items):
                raise FormatError("updates of a dictionary must follow each other")
            for x in i.many(one):
                table.index.setdefault(x, len(table.items))
                table.items.append(x)
            table.start = len(table.items)

    def update(self) -> bytes | None:
        if all(t.start == len(t.items) for t in (self.strings, self.paths, self.tags)):
            return None
        o, rest = _Out(), _Out()
        string = lambda s: rest.u32(self.strings(s))
        for table, one in ((self.paths, lambda p: rest.many(p, string)), (self.tags, lambda t: (rest.many([k for k, _ in t], string), rest.many([v for _, v in t], lambda v: rest.value(v, string))))):
            rest.u32(table.start)
            rest.many(table.pending(), one)
        o.u32(self.strings.start)
        o.many(self.strings.pending(), o.text)
        return bytes(o.data + rest.data)


def _segment(data: bytes, pointer: tuple[int, int], flags: int, packed: bool = True) -> _In:
    off, n = pointer
    end = off + n + -n % 4
    body = data[off:end]
    if len(data) < end + 4 or zlib.crc32(body) != struct.unpack_from(">I", data, end)[0]:
        raise FormatError("a segment's checksum differs")
    body = body[:n]
    kind = flags & COMPRESSION_MASK
    if not packed or not kind:
        return _In(body)
    if kind != GZIP:
        raise FormatError("unsupported compression")
    return _In(gzip.decompress(body))


def _add_segment(out: bytearray, body: bytes, flags: int, packed: bool = True) -> tuple[int, int]:
    if packed and flags & COMPRESSION_MASK == GZIP:
        body = gzip.compress(body, 9, mtime=0)
    at = len(out)
    padded = body + bytes(-len(body) % 4)
    out += padded + struct.pack(">I", zlib.crc32(padded))
    return at, len(body)


def _header2(first: int, last: int, flags: int, size: int, pointer: tuple[int, int]) -> bytes:
    o = _Out()
    o.data += _mime(2)
    o.put(">q", first).put(">q", last).u32(flags).u32(0).put(">Q", size).pointer(pointer)
    return bytes(o.data) + struct.pack(">I", zlib.crc32(bytes(o.data)))


def _open2(data: bytes) -> tuple[int, int, int, tuple[int, int]]:
    i = _In(data, MIME)
    first, last, flags = i.i64(), i.i64(), i.u32()
    i.u32()
    i.u64()
    pointer = i.pointer()
    if zlib.crc32(data[: MIME + HEADER2]) != i.u32():
        raise FormatError("the header's checksum differs")
    return first, last, flags, pointer


def _links(data: bytes, flags: int, pointer: tuple[int, int]) -> tuple[list, _Tables2]:
    """The scrapes of a list, oldest first, as (time, pointer to the records), and the dictionaries."""
    chain = []
    while pointer != (0, 0):
        i = _segment(data, pointer, flags, packed=False)
        t = i.i64()
        before = i.pointer() if i.flag() else (0, 0)
        update = i.pointer() if i.flag() else None
        chain.append((t, i.pointer(), update))
        pointer = before
    chain.reverse()
    d = _Tables2()
    for *_, update in chain:
        if update:
            d.read(_segment(data, update, flags))
    return chain, d


def _read_list(data: bytes, flags: int, pointer: tuple[int, int]) -> Iterator[Scrape]:
    chain, d = _links(data, flags, pointer)
    for t, records, _ in chain:
        groups: dict = {}
        i = _segment(data, records, flags)
        for _ in range(i.u32()):
            path = d.paths.at(i.u32())
            for _ in range(i.u32()):
                tags = d.tags.at(i.u32())
                m = _segment(data, i.pointer(), flags)
                groups.setdefault((path, tags), {}).update(m.many(lambda: (d.paths.at(m.u32()), m.value(lambda: d.strings.at(m.u32())))))
        yield t, groups


def _add_link(out: bytearray, s: Scrape, d: _Tables2, flags: int, before: tuple[int, int]) -> tuple[int, int]:
    by_path: dict = {}
    for (path, tags), metrics in s[1].items():
        m = _Out()
        m.many(metrics.items(), lambda x: (m.u32(d.paths(x[0])), m.value(x[1], lambda t: m.u32(d.strings(t)))))
        by_path.setdefault(d.paths(path), []).append((d.tags(tags), _add_segment(out, bytes(m.data), flags)))
    r = _Out()
    r.many(by_path.items(), lambda p: (r.u32(p[0]), r.many(p[1], lambda t: (r.u32(t[0]), r.pointer(t[1])))))
    records = _add_segment(out, bytes(r.data), flags)
    update = d.update()
    link = _Out().put(">q", s[0])
    for p in (before if before != (0, 0) else None, _add_segment(out, update, flags) if update else None):
        link.u32(p is not None)
        if p:
            link.pointer(p)
    link.pointer(records)
    link.u32(0)
    return _add_segment(out, bytes(link.data), flags, packed=False)


#: The columns of a metric in a block, in order: which values each holds.
_COLUMNS = (
    lambda v: isinstance(v, bool),
    lambda v: type(v) is int and -(1 << 15) <= v < 1 << 15,
    lambda v: type(v) is int and not -(1 << 15) <= v < 1 << 15 and -(1 << 31) <= v < 1 << 31,
    lambda v: type(v) is int and not -(1 << 31) <= v < 1 << 31 and -(1 << 63) <= v < 1 << 63,
    lambda v: type(v) is float or type(v) is int and not -(1 << 63) <= v < 1 << 63,
    lambda v: isinstance(v, str),
    lambda v: isinstance(v, (list, tuple)),
    lambda v: v is None,
)


def _read_tables(data: bytes, flags: int, pointer: tuple[int, int]) -> Iterator[Scrape]:
    def block(i: _In) -> tuple:
        t = [i.i64()]
        for d in i.many(i.i32):
            t.append(t[-1] + d)
        return t, i.pointer(), i.pointer()

    i = _segment(data, pointer, flags)
    for times, dictionary, tables in i.many(lambda: block(i)):
        d = _Tables2()
        d.read(_segment(data, dictionary, flags))
        scrapes: list[dict] = [{} for _ in times]
        ti = _segment(data, tables, flags)
        for path, tagged in ti.many(lambda: (d.paths.at(ti.u32()), ti.many(lambda: (d.tags.at(ti.u32()), ti.pointer())))):
            for tags, p in tagged:
                gi = _segment(data, p, flags)
                for at in gi.places():
                    if at < len(times):
                        scrapes[at].setdefault((path, tags), {})
                for metric, q in gi.many(lambda: (d.paths.at(gi.u32()), gi.pointer())):
                    for at, v in _columns(_segment(data, q, flags), d):
                        scrapes[at].setdefault((path, tags), {})[metric] = v
        yield from zip(times, scrapes)


def _columns(i: _In, d: _Tables2) -> Iterator[tuple[int, object]]:
    string = lambda: d.strings.at(i.u32())
    readers = (i.bits, lambda: i.many(i.i32), lambda: i.many(i.i32), lambda: i.many(i.i64), lambda: i.many(i.f64), lambda: i.many(string), lambda: i.many(i.histogram), None, lambda: i.many(lambda: i.value(string)))
    for read in readers:
        places = i.places()
        yield from zip(places, read() if read else [None] * len(places))


def _add_columns(values: dict[int, object], n: int, d: _Tables2) -> bytes:
    """values: by their places among n scrapes, in order."""
    o = _Out()
    string = lambda s: o.u32(d.strings(s))
    writers = (o.bits, lambda x: o.many(x, lambda v: o.put(">i", v)), lambda x: o.many(x, lambda v: o.put(">i", v)), lambda x: o.many(x, lambda v: o.put(">q", v)), lambda x: o.many(x, lambda v: o.put(">d", float(v))), lambda x: o.many(x, string), lambda x: o.many(x, lambda h: o.many(h, lambda r: [o.put(">d", float(y)) for y in r])), None)
    for holds, write in zip(_COLUMNS, writers):
        there = [at for at, v in values.items() if holds(v)]
        o.places(there, n)
        if write:
            write([values[at] for at in there])
    o.places([], n)
    o.u32(0)
    return bytes(o.data)


def _add_block(out: bytearray, scrapes: list[Scrape], flags: int) -> bytes:
    """A block of tables; gives its entry for the list of blocks."""
    d = _Tables2()
    groups: dict = {}
    for at, (_, gs) in enumerate(scrapes):
        for g, metrics in gs.items():
            for m, v in metrics.items():
                groups.setdefault(g, {}).setdefault(m, {})[at] = v
    by_path: dict = {}
    for (path, tags), metrics in groups.items():
        go = _Out()
        there = {at for m in metrics.values() for at in m}
        go.places(sorted(there), len(scrapes))
        placed = [(d.paths(m), _add_segment(out, _add_columns(v, len(scrapes), d), flags)) for m, v in metrics.items()]
        go.many(placed, lambda x: (go.u32(x[0]), go.pointer(x[1])))
        by_path.setdefault(d.paths(path), []).append((d.tags(tags), _add_segment(out, bytes(go.data), flags)))
    to = _Out()
    to.many(by_path.items(), lambda p: (to.u32(p[0]), to.many(p[1], lambda t: (to.u32(t[0]), to.pointer(t[1])))))
    tables = _add_segment(out, bytes(to.data), flags)
    dictionary = _add_segment(out, d.update() or bytes(24), flags)
    e = _Out().put(">q", scrapes[0][0])
    e.many(zip(scrapes, scrapes[1:]), lambda x: e.put(">i", x[1][0] - x[0][0]))
    e.pointer(dictionary)
    e.pointer(tables)
    return bytes(e.data)


# --- files ---


def read_file(path: str) -> Iterator[Scrape]:
    """The scrapes of a file, in the order of the file; of any version, gzipped or not."""
    data = _load(path)
    version = head(data)
    if version == 0:
        return _read0(_In(data, MIME + 16))
    if version == 1:
        return _read1(_In(data, MIME + 16))
    if version != 2:
        raise FormatError(f"version {version}")
    _, _, flags, pointer = _open2(data)
    if pointer == (0, 0):
        return iter(())
    return (_read_tables if flags & KIND_MASK == KIND_TABLES else _read_list)(data, flags, pointer)


def encode(scrapes: Iterable[Scrape], version: str = "2", packed: bool = False) -> bytes:
    """A whole file, sorted by time. version: '0', '1', '2' (list) or '2t' (tables); packed: gzipped, version 2 by segment."""
    ss = sorted(scrapes, key=lambda s: s[0])
    first, last = (ss[0][0], ss[-1][0]) if ss else (0, 0)
    if version in ("0", "1"):
        o, d = _Out(), _Tables1()
        o.data += _mime(int(version))
        o.put(">q", first).put(">q", last)
        for s in ss:
            _write0(o, s) if version == "0" else _write1(o, s, d)
        return gzip.compress(bytes(o.data), 9, mtime=0) if packed else bytes(o.data)
    if version not in ("2", "2t"):
        raise FormatError(f"version {version}")
    flags = SORTED | (DISTINCT if len({t for t, _ in ss}) == len(ss) else 0) | (GZIP if packed else 0) | (KIND_TABLES if version == "2t" else KIND_LIST)
    out = bytearray(MIME + HEADER2 + 4)
    pointer = (0, 0)
    if version == "2":
        d2 = _Tables2()
        for s in ss:
            pointer = _add_link(out, s, d2, flags, pointer)
    elif ss:
        blocks, part = [], [ss[0]]
        for s in ss[1:]:
            if s[0] - part[-1][0] > STEP:
                blocks.append(part)
                part = []
            part.append(s)
        entries = [_add_block(out, b, flags) for b in [*blocks, part]]
        pointer = _add_segment(out, struct.pack(">I", len(entries)) + b"".join(entries), flags)
    out[: MIME + HEADER2 + 4] = _header2(first, last, flags, len(out), pointer)
    return bytes(out)


def new_file(path: str, version: str = "2") -> None:
    """Creates an empty file; an existing one is an error, and so is an unknown version."""
    with open(path, "xb") as f:
        f.write(encode([], version))


def append(path: str, scrape: Scrape) -> None:
    """Appends a scrape to a file of version 0, 1 or 2 (list). Gzipped files and tables can't be written to. If writing fails the file is as it was."""
    with open(path, "rb") as f:
        data = f.read()
    if data[:2] == b"\x1f\x8b":
        raise FormatError("a gzipped file can't be written to")
    version, t = head(data), scrape[0]
    if version in (0, 1):
        i = _In(data, MIME)
        first, last = (i.i64(), i.i64()) if len(data) > MIME + 16 else (t, t)
        o, d = _Out(), _Tables1()
        if version == 0:
            _write0(o, scrape)
        else:
            for _ in _read1(_In(data, MIME + 16), d):
                pass
            _write1(o, scrape, d)
        new = data[:MIME] + struct.pack(">qq", min(first, t), max(last, t)) + data[MIME + 16 :] + o.data
    else:
        first, last, flags, pointer = _open2(data)
        if flags & KIND_MASK == KIND_TABLES:
            raise FormatError("tables can't be written to")
        fresh = pointer == (0, 0)
        if not fresh:
            flags &= ~(SORTED if t < last else 0) & ~(DISTINCT if t <= last else 0)
        out = bytearray(data)
        _, d2 = _links(data, flags, pointer)
        pointer = _add_link(out, scrape, d2, flags, pointer)
        out[: MIME + HEADER2 + 4] = _header2(t if fresh else min(first, t), t if fresh else max(last, t), flags, len(out), pointer)
        new = bytes(out)
    side = f"{path}.{uuid.uuid4().hex}"
    with open(side, "wb") as f:
        f.write(new)
    os.replace(side, path)


# --- Spark ---


def _mv(v) -> tuple:
    kind = 0 if v is None else 1 if isinstance(v, bool) else (2 if v < 0 else 3) if isinstance(v, int) else 4 if isinstance(v, float) else 5 if isinstance(v, str) else 6
    return kind, v if kind == 1 else None, v if kind in (2, 3) else None, None, v if kind == 4 else None, v if kind == 5 else None, [tuple(r) for r in v] if kind == 6 else None


def _plain(m):
    """The constant of an MV row; integers from 2**63 on become doubles when written."""
    k = m["kind"]
    return None if k == 0 else m["b"] if k == 1 else (m["i"] if m["i"] is not None else float(m["u"])) if k in (2, 3) else m["d"] if k == 4 else m["s"] if k == 5 else tuple((r["lo"], r["hi"], r["cnt"]) for r in m["h"])


@dataclass
class _File(InputPartition):
    path: str


def _local(path: str) -> str:
    """The path of a folder or file given as a path or as a file URI, in any of its forms (Spark names its own folders file:/folder). As in Spark, nothing is unescaped."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", path)
    if not scheme:
        return path
    folder = re.fullmatch(r"file:(?://(?:localhost)?)?(/(?!/).*)", path, re.I | re.S)
    if not folder:
        raise ValueError(f"native history files lie in a folder that all executors see as a local one, not in {path}")
    return folder[1]


class _Reader(DataSourceReader):
    def __init__(self, options, schema=None):
        self.folder = _local(options["path"])
        self.begin, self.end = (int(options[k]) if options.get(k) is not None else None for k in ("begin", "end"))
        self.schema = schema

    def partitions(self):
        """One task a file; files outside begin..end are pruned by their headers."""
        files = [os.path.join(self.folder, n) for n in sorted(os.listdir(self.folder))] if os.path.isdir(self.folder) else [self.folder]
        out = []
        for f in filter(is_history, files):
            first, last = bounds(f)
            if not (self.end is not None and first > self.end or self.begin is not None and last < self.begin):
                out.append(_File(f))
        return out or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        from tsq.sources import native_columns as nc

        batches = nc.read_batches(partition.path, to_arrow_schema(self.schema), self.begin, self.end)
        yield from self.rows(partition.path) if batches is None else batches

    def rows(self, path):
        for t, groups in read_file(path):
            if self.begin is not None and t < self.begin or self.end is not None and t > self.end:
                continue
            for (path, tags), metrics in groups.items():
                for metric, v in metrics.items():
                    yield t, list(path), [(k, _mv(x)) for k, x in tags], list(metric), _mv(v)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.folder = _local(options["path"])
        self.version, self.packed, self.latest = options.get("version", "2"), options.get("packed", "false").lower() == "true", options.get("latest")
        os.makedirs(self.folder, exist_ok=True)
        # overwriting replaces the folder's history files and leaves others alone
        self.old = [f for n in os.listdir(self.folder) if is_history(f := os.path.join(self.folder, n))] if overwrite else []

    def write(self, batches):
        from tsq.sources import native_columns as nc

        samples = nc.collect(batches, self.version == "0", self.latest)
        if samples is None:
            return _Written("")
        path = os.path.join(self.folder, f"{samples.t[0]}-{uuid.uuid4().hex}.tsd")
        by_columns = None if self.packed else {"0": nc.encode0, "2": nc.encode2}.get(self.version)
        with open(path + ".part", "wb") as f:
            f.write(by_columns(samples) if by_columns else encode(samples.scrapes(), self.version, self.packed))
        return _Written(path)

    def commit(self, messages):
        # first the new files, then without the old ones: a failure in between loses neither
        for m in messages:
            if m and m.path:
                os.replace(m.path + ".part", m.path)
        for p in self.old:
            os.path.isfile(p) and os.remove(p)

    def abort(self, messages):
        for m in messages:
            if m and m.path and os.path.exists(m.path + ".part"):
                os.remove(m.path + ".part")


class HistoryFiles(DataSource):
    """Format 'history': spark.read.format('history').load(folder), df.write.format('history').save(folder).

    Reading: options begin and end (ms, inclusive) prune files by their headers and scrapes by their times. Writing: each task writes one file of its rows, sorted by
    time; so repartition by range of time first. Options version ('0', '1', '2', '2t') and packed. Of equal series and times in a task's rows the later counts, or with
    the option latest that with the greatest number in the column so named, which isn't written.
    """

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return SAMPLES_DDL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)
