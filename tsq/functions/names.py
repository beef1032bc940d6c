"""Path and tag matchers: as column predicates, and their overlap as a planner utility."""

from dataclasses import dataclass, field
from functools import reduce
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsq.functions import values as va

#: Separator that joins a path's parts for matching; it can't be written in a literal name without an escape.
SEP = "\x1f"


class Star:
    def __repr__(self) -> str:
        return "*"


class DoubleStar:
    def __repr__(self) -> str:
        return "**"


STAR, DOUBLE_STAR = Star(), DoubleStar()


@dataclass(frozen=True)
class PathMatcher:
    """A whole-path matcher: literals, STAR (exactly one part), DOUBLE_STAR (any number of parts)."""

    parts: tuple

    def __post_init__(self):
        # '** *' is '* **', '** **' is '**'
        out: list = []
        for p in self.parts:
            if p is DOUBLE_STAR and out and out[-1] is DOUBLE_STAR:
                continue
            if p is STAR and out and out[-1] is DOUBLE_STAR:
                out.insert(len(out) - 1, STAR)
                continue
            out.append(p)
        object.__setattr__(self, "parts", tuple(out))

    def literal(self) -> list[str] | None:
        return None if any(not isinstance(p, str) for p in self.parts) else list(self.parts)

    def regex(self) -> str:
        """Anchored pattern over the parts, each followed by SEP."""
        one = f"[^{SEP}]*{SEP}"
        return "^" + "".join(one if p is STAR else f"(?:{one})*" if p is DOUBLE_STAR else _java_quote(p) + SEP for p in self.parts) + "$"

    def column(self, path: Column) -> Column:
        """Predicate on an array of strings: tests of length and of the parts up to the first star, which reach the scan where a part is a column of it; then, with a star, the pattern."""
        fixed = sum(p is not DOUBLE_STAR for p in self.parts)
        size = F.size(path) >= fixed if DOUBLE_STAR in self.parts else F.size(path) == fixed
        out = size
        for i, p in enumerate(self.parts):
            if not isinstance(p, str):
                break
            out = out & (F.get(path, F.lit(i)) == p)
        if self.parts in ((DOUBLE_STAR,),):
            return path.isNotNull()
        if self.literal() is not None:
            return out
        return out & F.concat(F.array_join(path, SEP, ""), F.when(F.size(path) > 0, SEP).otherwise("")).rlike(self.regex())

    def prefix(self) -> list[str]:
        """The parts before the first star."""
        stars = [i for i, p in enumerate(self.parts) if not isinstance(p, str)]
        return list(self.parts[: stars[0]] if stars else self.parts)

    def joined(self, column: Column) -> Column:
        """Needed of a path's parts joined, each followed by SEP, by any match: a comparison that a scan can take."""
        text = "".join(p + SEP for p in self.prefix())
        return column == text if self.literal() is not None else column.startswith(text) if text else F.lit(True)

    def matches(self, path: list[str]) -> bool:
        return re.match(_py(self), "".join(p + SEP for p in path)) is not None

    def overlaps(self, other: "PathMatcher") -> bool:
        """Whether some path matches both."""
        a, b = self.parts, other.parts
        seen = {}

        def both(i: int, j: int) -> bool:
            if (i, j) not in seen:
                seen[i, j] = False
                if i == len(a) and j == len(b):
                    r = True
                elif i < len(a) and a[i] is DOUBLE_STAR:
                    r = both(i + 1, j) or (j < len(b) and both(i, j + 1))
                elif j < len(b) and b[j] is DOUBLE_STAR:
                    r = both(i, j + 1) or (i < len(a) and both(i + 1, j))
                else:
                    r = i < len(a) and j < len(b) and (a[i] is STAR or b[j] is STAR or a[i] == b[j]) and both(i + 1, j + 1)
                seen[i, j] = r
            return seen[i, j]

        return both(0, 0)


def _java_quote(s: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in s)


def _py(m: PathMatcher) -> str:
    one = f"[^{SEP}]*{SEP}"
    return "^" + "".join(one if p is STAR else f"(?:{one})*" if p is DOUBLE_STAR else re.escape(p) + SEP for p in m.parts) + r"\Z"


ANY = PathMatcher((DOUBLE_STAR,))

COMPARISONS = {"=": va.equal, "!=": va.not_equal, "<": va.less, ">": va.greater, "<=": va.less_equal, ">=": va.greater_equal}


@dataclass(frozen=True)
class TagTest:
    """One test on a tag. op: 'present', 'absent' or a comparison with value (a Python constant)."""

    name: str
    op: str
    value: object = None


def tag_value(tags: Column, name: str) -> Column:
    """The value of a tag, absent if there is none."""
    return F.get(F.filter(tags, lambda t: t.k == name), F.lit(0)).getField("v")


@dataclass(frozen=True)
class TagMatcher:
    """A conjunction of tests; a key may be tested more than once."""

    tests: tuple[TagTest, ...] = field(default=())

    def column(self, tags: Column) -> Column:
        """Predicate on a tag array. A comparison with an absent tag, or one that isn't defined, is false; null tags have no keys."""
        tags = F.coalesce(tags, F.array().cast(_tags_type()))
        return reduce(lambda a, b: a & b, [self._test(t, tags) for t in self.tests], F.lit(True))

    def plain(self, columns: dict[str, str], types: dict[str, str]) -> list[Column]:
        """Comparisons of scanned columns that the tests imply, for tags (by name) that are such columns of texts or whole numbers: a scan can take them."""
        ops = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}
        out = []
        for t in self.tests:
            if t.name not in columns:
                continue
            c = F.col(columns[t.name])
            if t.op == "absent":
                out.append(c.isNull())
                continue
            out.append(c.isNotNull())
            text = types[columns[t.name]] == "string"
            known = isinstance(t.value, str) and t.op in ("=", "!=") if text else isinstance(t.value, (int, float)) and not isinstance(t.value, bool) and math.isfinite(t.value)
            if known and t.op in ops:
                out.append(getattr(c, ops[t.op])(F.lit(t.value)))
        return out

    @staticmethod
    def _test(t: TagTest, tags: Column) -> Column:
        there = F.exists(tags, lambda x: x.k == t.name)
        if t.op == "present":
            return there
        if t.op == "absent":
            return ~there
        return F.coalesce(COMPARISONS[t.op](tag_value(tags, t.name), va.literal(t.value))["b"], F.lit(False))

    def overlaps(self, other: "TagMatcher") -> bool:
        """Whether some tag set may satisfy both; never false if one does."""
        names = {t.name for t in (*self.tests, *other.tests)}
        return all(_satisfiable([t for t in (*self.tests, *other.tests) if t.name == n]) for n in names)


def _tags_type() -> str:
    from tsq.schema import TAGS_DDL

    return TAGS_DDL


def _number(v) -> float | None:
    return v if isinstance(v, (int, float)) else None


def _satisfiable(tests: list[TagTest]) -> bool:
    """Whether one tag's tests can hold together: absent with anything else can't, and comparisons must leave a value."""
    ops = {t.op for t in tests}
    if "absent" in ops:
        return ops == {"absent"}
    comparisons = [t for t in tests if t.op != "present"]
    texts = [t for t in comparisons if isinstance(t.value, str)]
    numbers = [t for t in comparisons if not isinstance(t.value, str)]
    if texts:
        # only texts can be compared with texts, and only for equality
        equal = {t.value for t in texts if t.op == "="}
        return not numbers and all(t.op in ("=", "!=") for t in texts) and len(equal) <= 1 and not (equal & {t.value for t in texts if t.op == "!="})
    lo, hi, lo_in, hi_in, out = -math.inf, math.inf, True, True, set()
    for t in numbers:
        v = _number(t.value)
        if v is None or v != v:
            return t.op == "!=" and len(comparisons) == 1
        if t.op in ("=", ">", ">=") and (v > lo or v == lo and t.op == ">"):
            lo, lo_in = v, t.op != ">"
        if t.op in ("=", "<", "<=") and (v < hi or v == hi and t.op == "<"):
            hi, hi_in = v, t.op != "<"
        if t.op == "!=":
            out.add(v)
    return lo < hi or lo == hi and lo_in and hi_in and lo not in out
