"""Splitting oversized texts at natural boundaries, by agglomerative merging of atomic segments."""

import heapq
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.llm.bpe import VOCABULARY, PairIndexBPE, broadcast_vocabulary, loaded

LIMIT, OVERLAP = 512, 64

#: Strength of the boundary after an atom: none within a word, between words, clauses, sentences, lines, paragraphs.
INSIDE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_SENTENCE = re.compile(r"""[.!?…。！？｡][)\]"'”’»」』]*\s*$""")
_CLAUSE = re.compile(r"[,;:、，；：)\]]\s*$")


#: Words whose classes a worker keeps.
KEPT_CLASSES = 200_000


def _wide(s: str) -> bool:
    """Whether the script writes no blanks between words, by the first character."""
    c = s.lstrip()[:1]
    return "⺀" <= c <= "힣" or "＀" <= c <= "￯"


class _Boundaries:
    """Strength of the boundary between two neighbouring words (as split by the tokenizer, blanks leading). What a word does to
    either side is looked at once per distinct word, and a pair of such classes is judged once."""

    def __init__(self) -> None:
        self.classes: dict[str, int] = {}  # number of each word's class
        self.kinds: dict[tuple, int] = {}
        self.pairs: dict[int, int] = {}

    @staticmethod
    def _look(w: str) -> tuple:
        blank = w.isspace()
        lead = w if blank else w[: len(w) - len(w.lstrip())]
        end = SENTENCE if _SENTENCE.search(w) else CLAUSE if _CLAUSE.search(w) else WORD
        return blank, min(2, lead.count("\n")), bool(lead), end, _wide(w)

    @staticmethod
    def _judge(left: tuple, right: tuple) -> int:
        l_blank, l_lines, _, l_end, l_wide = left
        r_blank, r_lines, r_lead, _, r_wide = right
        lines = (l_lines if l_blank else 0) + r_lines
        if lines:
            # a line break belongs to the blank word before the text that follows
            return INSIDE if r_blank else PARAGRAPH if lines > 1 else LINE
        if r_blank:
            return INSIDE
        if l_end == SENTENCE:
            return SENTENCE if r_lead or r_wide or l_wide else WORD
        if l_end == CLAUSE:
            return CLAUSE
        return WORD if r_lead or r_wide or l_blank else INSIDE

    def strengths(self, words: list[str]) -> list[int]:
        """Of the boundary after each word; after the last one a paragraph's."""
        classes, pairs = self.classes, self.pairs
        if len(classes) > KEPT_CLASSES:
            classes.clear()
        for w in {*words}.difference(classes):
            classes[w] = self.kinds.setdefault(self._look(w), len(self.kinds))
        of = [classes[w] for w in words]
        both = [x << 12 | y for x, y in zip(of, of[1:])]  # the kinds are few: less than 2**12
        for p in {*both}.difference(pairs):
            kinds = list(self.kinds)
            pairs[p] = self._judge(kinds[p >> 12], kinds[p & 4095])
        return [*[pairs[p] for p in both], PARAGRAPH]

    def pair(self, left: str, right: str) -> int:
        return self._judge(self._look(left), self._look(right))


_BOUNDARIES = _Boundaries()


def atoms(bpe: PairIndexBPE, words: list[str], ids: list[tuple[int, ...]], most: int) -> tuple[list[str], list[int], list[int], list[bool]]:
    """Texts, tokens, strengths of the boundary after each, and whether each is a part of a word, of the atomic segments: words, those of more than most tokens cut between characters."""
    sizes, ends = list(map(len, ids)), _BOUNDARIES.strengths(words)
    if max(sizes, default=0) <= most:
        return words, sizes, ends, [False] * len(words)
    out: tuple[list, list, list, list] = [], [], [], []
    for w, n, end in zip(words, sizes, ends):
        if n <= most:
            rows = [(w, n, end, False)]
        else:
            # every character has at most 4 bytes and so at most 4 tokens
            step = max(1, most // 4)
            parts = [w[i : i + step] for i in range(0, len(w), step)]
            rows = [(p, len(y), INSIDE, True) for p, y in zip(parts, bpe.merge([p.encode() for p in parts]))]
            rows[-1] = (*rows[-1][:2], end, True)
        for row in rows:
            for column, x in zip(out, row):
                column.append(x)
    return out


def segments(sizes: list[int], strengths: list[int], limit: int, overlap: int) -> list[int]:
    """First atoms of the segments that are left when no two neighbours fit together: the weakest boundary is merged first, of equally weak ones that of the smaller pair, then the earlier one.

    Adjacent pairs wait in a heap, named by the boundary between them (the atom after it). A pair fits while its size plus the overlap is within the limit. Since
    segments only grow, one that doesn't fit never will, and an entry may be out of date only by being too small: it is put right when its turn comes.
    """
    n = len(sizes)
    size, left, right = list(sizes), list(range(-1, n - 1)), list(range(1, n + 1))  # segments, by their first atom
    # an entry is one number: strength of the boundary, size of the pair, the boundary
    bits, room = n.bit_length(), limit - overlap
    span = (room + 1).bit_length()
    low, high, sizes_at = (1 << bits) - 1, ~((1 << bits + span) - 1), (1 << span) - 1
    heap = [(strengths[i - 1] << span | t) << bits | i for i in range(1, n) if (t := sizes[i - 1] + sizes[i]) <= room]
    heapq.heapify(heap)
    gone = bytearray(n)
    pop, replace = heapq.heappop, heapq.heapreplace
    while heap:
        e = heap[0]
        b = e & low
        a = left[b]
        total = size[a] + size[b]
        if total > room:
            pop(heap)
        elif total != e >> bits & sizes_at:
            replace(heap, e & high | total << bits | b)
        else:
            pop(heap)
            size[a], gone[b] = total, 1
            c = right[a] = right[b]
            if c < n:
                left[c] = a
    return [i for i in range(n) if not gone[i]]


def pieces(bpe: PairIndexBPE, words: list[str], ids: list[tuple[int, ...]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(first character, end, tokens, tokens of the overlap) of each piece of a text. Consecutive pieces share the overlap; without it they make up the text.

    The tokens of a piece are those that it has by itself. The tokenizer splits words without looking back, so between two words a piece's words are those of
    the text, and its tokens their sum; but blanks at the end of a piece may join, and a word that was cut has other tokens. Only such pieces are encoded again.
    """
    if sum(map(len, ids)) <= limit:
        text = "".join(words)
        return [(0, len(text), sum(map(len, ids)), 0)]
    at, sizes, ends, part = atoms(bpe, words, ids, max(4, min(overlap, (limit - overlap) // 2) if overlap else limit // 2))
    starts = segments(sizes, ends, limit, overlap)
    place, upto, parts = [0, *accumulate(map(len, at))], [0, *accumulate(sizes)], [0, *accumulate(part)]
    text = "".join(words)
    out = []
    prev = 0  # first atom of the piece before
    for k, s in enumerate(starts):
        e = starts[k + 1] if k + 1 < len(starts) else len(at)
        a, over = s, 0
        while k and a - 1 > prev and over + sizes[a - 1] <= overlap:
            a -= 1
            over += sizes[a]
        joined = e - 1 > a and at[e - 1].isspace() and at[e - 2].isspace()

        def tokens(a: int, e: int = e, joined: bool = joined) -> int:
            """Of the piece by itself."""
            return len(next(iter(bpe.encode([text[place[a] : place[e]]])))) if joined or parts[e] > parts[a] else upto[e] - upto[a]

        # where a cut changes the tokens at the ends of a piece, the overlap gives way
        while (n := tokens(a)) > limit and a < s:
            over -= sizes[a]
            a += 1
        out.append((place[a], place[e], n, over))
        prev = a
    return out


def split_texts(df: DataFrame, ident: str = "doc_id", text: str = "text", *, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY, oversized_only: bool = True) -> DataFrame:
    """Cuts the texts of more than limit tokens into pieces: ident, piece_no (from 0), first_char, end_char, n_tokens, overlap_tokens, piece.

    No piece has more than limit tokens. Cuts lie at paragraphs, lines, sentences, clauses or words, the weakest boundaries being merged away first, and
    inside a word only where it alone is too long; each next piece starts with the last overlap tokens of the one before, or from the nearest boundary below that.
    Without the overlaps the pieces make up the text. Shorter texts give no row, or with oversized_only=False one piece (an empty text an empty one).
    Null texts give no row. Repeated rows are split each; other columns are ignored. No shuffle: a text is cut where it is read.
    A text of at most limit bytes can't have more tokens, so those never leave the JVM.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("the overlap must be at most half the limit")
    definition = broadcast_vocabulary(df.sparkSession, vocabulary)
    rows = df.where(F.col(text).isNotNull())
    if oversized_only:
        rows = rows.where(F.octet_length(text) > limit)
    rows = rows.select(ident, text)
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(definition)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            texts = batch.column(1).to_pylist()
            for i, (t, (ws, ids)) in enumerate(zip(texts, bpe.words(texts))):
                if oversized_only and sum(map(len, ids)) <= limit:
                    continue
                for k, (a, e, n, over) in enumerate(pieces(bpe, ws, ids, limit, overlap)):
                    for column, x in zip(out, (i, k, a, e, n, over, t[a:e])):
                        column.append(x)
            idents = batch.column(0).take(pa.array(out[0], pa.int32()))
            ints = [pa.array(c, pa.int32()) for c in out[1:6]]
            yield pa.RecordBatch.from_arrays([idents, *ints, pa.array(out[6], pa.string())], names=["ident", "piece_no", "first_char", "end_char", "n_tokens", "overlap_tokens", "piece"])

    return rows.mapInArrow(run, f"`{ident}` {kind}, piece_no int, first_char int, end_char int, n_tokens int, overlap_tokens int, piece string")
