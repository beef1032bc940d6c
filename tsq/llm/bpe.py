"""Byte-level BPE of a whole corpus with a public tokenizer, by a pair occurrence index."""

import heapq
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabularies lie; a parameter of every operator that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 64 << 20
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids in a worker, the longest word kept, and the characters of text indexed at once.
KEPT_WORDS, KEPT_LENGTH, BLOCK_CHARS = 300_000, 200, 4_000_000


def _byte_symbols() -> list[str]:
    """The character by which vocabulary files write each byte: itself if it is printable, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class PairIndexBPE:
    """Encoder with the vocabulary and merges of a tokenizer file (its JSON text)."""

    def __init__(self, definition: str):
        model = json.loads(definition)["model"]
        vocab = model["vocab"]
        if max(vocab.values()) >= 1 << 21:
            raise ValueError("the vocabulary is too large")
        self.bytes = [vocab[c] for c in _byte_symbols()]
        self.merges, self.ranks = [], {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = vocab[a], vocab[b]
            self.merges.append((x, y, vocab[a + b]))
            self.ranks.setdefault(x << 21 | y, rank)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word. All words are laid out in one list of symbols; the index has the positions of every mergeable pair in it.

        The active ranks are applied in ascending order, each at all its positions at once; a merge only looks up its two new pairs.
        """
        sym: list[int] = []
        starts = []
        table, ranks, merges = self.bytes, self.ranks, self.merges
        for w in words:
            starts.append(len(sym))
            sym.extend([table[b] for b in w])
            sym.append(-1)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = defaultdict(list)
        find = ranks.get
        for i in range(n - 1):
            if sym[i] >= 0 and sym[i + 1] >= 0 and (r := find(sym[i] << 21 | sym[i + 1])) is not None:
                index[r].append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, ab = merges[rank]
            where = index.pop(rank)
            where.sort()  # of overlapping pairs the left one merges
            for i in where:
                if sym[i] != a:
                    continue
                j = after[i]
                if sym[j] != b:
                    continue
                k = after[j]
                sym[i], sym[j], after[i], before[k] = ab, -2, k, i
                h = before[i]
                if h >= 0 and (s := sym[h]) >= 0 and (r := find(s << 21 | ab)) is not None:
                    if r not in index:
                        heapq.heappush(active, r)
                    index[r].append(h)
                if (s := sym[k]) >= 0 and (r := find(ab << 21 | s)) is not None:
                    if r not in index:
                        heapq.heappush(active, r)
                    index[r].append(i)
        out = []
        for i in starts:
            ids = []
            while (s := sym[i]) >= 0:
                ids.append(s)
                i = after[i]
            out.append(tuple(ids))
        return out

    def words(self, texts: Iterable[str]) -> Iterator[tuple[list[str], list[tuple[int, ...]]]]:
        """Each text's words and their ids. Words not known yet are merged together, in blocks of BLOCK_CHARS characters."""
        block, chars = [], 0
        for t in texts:
            block.append(t)
            chars += len(t)
            if chars >= BLOCK_CHARS:
                yield from self._block(block)
                block, chars = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterator[tuple[list[str], list[tuple[int, ...]]]]:
        split = [self.split(t) for t in texts]
        new = {w for ws in split for w in ws}.difference(self.known)
        if new:
            order = list(new)
            ids = dict(zip(order, self.merge([w.encode() for w in order])))
            if len(self.known) + len(ids) > KEPT_WORDS:
                # start over with this block's words: memory stays bounded on any corpus
                ids |= {w: self.known[w] for ws in split for w in ws if w in self.known}
                self.known = {}
        else:
            ids = {}
        look = self.known if not ids else {**self.known, **ids} if len(self.known) < len(ids) else None
        if look is None:
            known = self.known
            for ws in split:
                yield ws, [ids[w] if w in ids else known[w] for w in ws]
        else:
            for ws in split:
                yield ws, [look[w] for w in ws]
        self.known.update((w, x) for w, x in ids.items() if len(w) <= KEPT_LENGTH)
        if len(self.known) > KEPT_WORDS:
            self.known = {}

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for _, ids in self.words(texts):
            yield [i for w in ids for i in w]


_LOADED: dict[int, PairIndexBPE] = {}


def loaded(definition) -> PairIndexBPE:
    """The encoder of a broadcast definition, built once in a worker."""
    if definition.value[0] not in _LOADED:
        _LOADED.clear()
        _LOADED[definition.value[0]] = PairIndexBPE(definition.value[1])
    return _LOADED[definition.value[0]]


def broadcast_vocabulary(spark, path: str):
    """The tokenizer file as a broadcast, so that executors need no copy of it; its size is bounded by VOCABULARY_BYTES."""
    text = open(path, encoding="utf-8").read()
    if len(text) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return spark.sparkContext.broadcast((hash(text), text))


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the column ids, the list of the text's token ids. No shuffle; df's other columns pass through in Arrow batches.

    Special tokens are neither added nor recognised: their strings are ordinary text. An empty text gives an empty list, a null text null.
    Texts of any length are encoded whole; repeated rows stay. A column named as ids, in any case, is refused. An empty table gives an empty one.
    """
    if ids.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {ids} already")
    definition = broadcast_vocabulary(df.sparkSession, vocabulary)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(definition)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            offsets, flat = [0], []
            null = [t is None for t in texts]
            for x in bpe.encode(t or "" for t in texts):
                flat += x
                offsets.append(len(flat))
            if any(null):
                offsets = [None if m else o for m, o in zip([*null, False], offsets)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])

    return df.mapInArrow(run, schema)
