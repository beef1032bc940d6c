"""Evaluation texts leaking into training text: pigeonhole pieces, verified by Myers' bit-parallel distance."""

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Successive words of an item that make a leak, and the words of them that may be replaced, left out or parted.
WINDOW, ERRORS = 12, 2
#: Items matched in one pass over the corpus: what is broadcast is at most so many items of at most so many characters together.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 8_000_000

_PARTING = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|h[1-6]|blockquote|hr|table)\b[^<>]*>|<!--.*?-->", re.I | re.S)
_MARKUP = re.compile(r"</?[a-z][^<>]*>", re.I)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_JOINING = re.compile(r"[*_`~'’‘ʼ´]+")
_WORD = re.compile(r"[^\W_]+")
#: Letters that stand for two and have no compatibility decomposition.
_TWO = str.maketrans({"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i"})


def words(text: str) -> list[str]:
    """The words of a text without what doesn't count: case, accents, ligatures, punctuation, spacing, quoting of lines, markup, character entities, invisible characters."""
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _MARKUP.sub("", _PARTING.sub(" ", text))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join([c for c in text if unicodedata.category(c) not in ("Mn", "Cf", "Me")]).casefold().translate(_TWO)
        text = unicodedata.normalize("NFKD", text) if not text.isascii() else text
    else:
        text = text.lower()
    return _WORD.findall(_JOINING.sub("", text))


def myers(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Least edit distance of a pattern of size words to any part of text. masks: bit i of a word is set where the pattern has it."""
    pv, mv, score, top = (1 << size) - 1, 0, size, 1 << (size - 1)
    full = pv
    best = size
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # a match may begin anywhere, so no bit enters from above
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best = score
    return best


class Matcher:
    """Finds the items of which a text holds a window of WINDOW words with at most ERRORS edits.

    Any such window, cut into ERRORS + 1 pieces, has a piece without an edit; so the exact hits of all pieces of all windows are
    looked up first, and only windows with a hit are verified.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, errors: int = ERRORS):
        self.window, self.errors = window, errors
        self.piece = window // (errors + 1)
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.index: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for ident, text in items:
            ws = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            n = len(self.items)
            self.items.append((ident, ws))
            if len(ws) >= window:
                for k in range(len(ws) - self.piece + 1):
                    self.index[tuple(ws[k : k + self.piece])].append((n, k))
        self.masks: dict[tuple[int, int], dict[int, int]] = {}

    def _mask(self, n: int, s: int) -> dict[int, int]:
        if (n, s) not in self.masks:
            if len(self.masks) > 100_000:
                self.masks.clear()
            m: dict[int, int] = defaultdict(int)
            for i, w in enumerate(self.items[n][1][s : s + self.window]):
                m[w] |= 1 << i
            self.masks[n, s] = dict(m)
        return self.masks[n, s]

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item, edits of its best window) of each item leaked in the text."""
        get = self.ids.get
        ws = [get(w, 0) for w in words(text)]
        p, window, errors, index = self.piece, self.window, self.errors, self.index
        found: dict[int, int] = {}
        tried: set[tuple[int, int, int]] = set()
        for at in range(len(ws) - p + 1):
            if not (ws[at] and ws[at + p - 1]):
                continue
            for n, k in index.get(tuple(ws[at : at + p]), ()):
                if found.get(n) == 0:
                    continue
                size = len(self.items[n][1])
                for piece in range(errors + 1):
                    s = k - piece * p
                    first = at - piece * p
                    if s < 0 or s + window > size or (n, s, first) in tried:
                        continue
                    tried.add((n, s, first))
                    d = myers(self._mask(n, s), window, ws[max(0, first - errors) : first + window + errors])
                    if d <= found.get(n, errors):
                        found[n] = d
                        if d == 0:
                            break
        return [(self.items[n][0], d) for n, d in found.items()]


_BUILT: dict[str, Matcher] = {}


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in bounded blocks, streamed to the driver one after the other."""
    block, chars = [], 0
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(r.t) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r.i, r.t))
        chars += len(r.t)
    if block:
        yield block


def leaks(items: DataFrame, docs: DataFrame, *, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", window: int = WINDOW, errors: int = ERRORS) -> DataFrame:
    """Each pair of an item and a document whose text holds at least window successive words of the item with at most errors edits: item_id, doc_id, edits.

    Every window of every item is looked for in the whole of every text. Items and texts are normalised alike (see words). A pair comes once, however
    often it occurs or its rows are repeated. Null ids and texts match nothing, empty texts neither, nor items of fewer than window words. Other columns are ignored.

    The held-out items are the query set: they go out in broadcast blocks of bounded size, one pass over the corpus each, and no text is shuffled;
    only the pairs found are.
    """
    if window % (errors + 1):
        raise ValueError("the window must be a multiple of errors + 1")
    spark = docs.sparkSession
    texts = docs.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text"))
    schema = "item_id bigint, doc_id bigint, edits int"
    out = None
    for block in _blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast((f"{hash(tuple(block))}/{window}/{errors}", block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            key, part = sent.value
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = Matcher(part, window, errors)
            m = _BUILT[key]
            for batch in batches:
                rows = [(i, d, e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, e in m.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names=["item_id", "doc_id", "edits"])

        pairs = texts.mapInArrow(run, schema)
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"))
