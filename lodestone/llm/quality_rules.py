"""Quality rules as a short-circuit cascade.

Rules are chosen one after the other on a bounded sample: the next is the one with the most rejections per second among
the documents that the rules before it let pass, where what those have counted costs nothing more. A document's first
rejection ends its cascade. The order changes only the work: a document is kept if no rule rejects it, whatever the order.

Nulls and empty texts have no words, so the base rule on short texts rejects them. Very long texts are read whole.
Repeated rows are judged alike, each on its own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from operator import eq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Documents of which costs and rejections are estimated; decisions do not depend on it.
SAMPLE_ROWS = 400


class Facts:
    """Counts of one text, each made when a rule first asks for it."""

    __slots__ = ("_made", "text")

    def __init__(self, text: str | None):
        self.text, self._made = text or "", {}

    def again(self) -> Facts:
        """The same text with the counts made so far."""
        other = Facts(self.text)
        other._made = dict(self._made)
        return other

    def _get(self, name: str, make: Callable[[], object]):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def words(self) -> list[bytes]:
        return self._get("words", lambda: self.text.encode("utf-8", "surrogatepass").split())

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return self._get("word_chars", lambda: len(self.text) - sum(map(self.text.count, SPACES)))

    @property
    def n_symbols(self) -> int:
        return self._get("n_symbols", lambda: sum(map(self.text.count, SYMBOLS)))

    @property
    def lines(self) -> list[str]:
        return self._get("lines", lambda: [x for x in self.text.split("\n") if x.strip(SPACES)])

    @property
    def n_dup_lines(self) -> int:
        return self._get("n_dup_lines", lambda: len(self.lines) - len(set(self.lines)))

    @property
    def n_repeat_words(self) -> int:
        return self._get("n_repeat_words", lambda: repeat_words(self.words))

    @property
    def n_stutters(self) -> int:
        return self._get("n_stutters", lambda: sum(map(eq, self.words, self.words[1:])))

    @property
    def n_upper(self) -> int:
        return self._get("n_upper", lambda: sum(1 for w in self.text.split() if len(w) > 1 and w.isupper()))

    @property
    def n_alpha_words(self) -> int:
        return self._get("n_alpha_words", lambda: sum(1 for w in self.text.split() if any(map(str.isalpha, w))))


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that stand in a window of width words found at least twice, the first one's included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = end = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + width - max(at, end)
            end = at + width
    return covered


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


def too_short(f: Facts) -> bool:
    return f.n_words < 20


def too_repetitive(f: Facts) -> bool:
    return 100 * f.n_repeat_words > 30 * f.n_words


def symbol_heavy(f: Facts) -> bool:
    return 10 * f.n_symbols > f.n_words


def repeated_lines(f: Facts) -> bool:
    """Over half the lines; in short documents one repeated heading is a third of them."""
    return 2 * f.n_dup_lines > len(f.lines)


def stuttering(f: Facts) -> bool:
    return 10 * f.n_stutters > 3 * f.n_words


def odd_word_length(f: Facts) -> bool:
    return not 2 * f.n_words <= f.word_chars <= 20 * f.n_words


def mostly_shouted(f: Facts) -> bool:
    return 10 * f.n_upper > 4 * max(f.n_words, 1)


def few_letters(f: Facts) -> bool:
    return 10 * f.n_alpha_words < 7 * f.n_words


BASE = (Rule("too_short", too_short), Rule("too_repetitive", too_repetitive))
RULES = (*BASE, Rule("symbol_heavy", symbol_heavy), Rule("repeated_lines", repeated_lines), Rule("stuttering", stuttering), Rule("odd_word_length", odd_word_length), Rule("mostly_shouted", mostly_shouted), Rule("few_letters", few_letters))


@dataclass
class Cascade:
    """Rules in the order of conditional rejections per second of cost; equal ranks keep their given order."""

    rules: tuple[Rule, ...] = RULES
    #: cost in seconds and share of rejections of each rule, at its place
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def fitted(cls, texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> Cascade:
        left, passed, order, stats = list(rules), [Facts(t) for t in texts], [], {}
        while left:
            tried = {}
            for rule in left:
                facts = [f.again() for f in passed]  # a rule's cost holds what it has to count beyond the rules before it
                began = time.perf_counter()
                hits = [rule.rejects(f) for f in facts]
                tried[rule.name] = ((time.perf_counter() - began) / max(1, len(facts)) + 1e-9, sum(hits) / max(1, len(facts)), [f for f, hit in zip(facts, hits, strict=True) if not hit])
            best = max(left, key=lambda r: tried[r.name][1] / tried[r.name][0])
            stats[best.name], passed = tried[best.name][:2], tried[best.name][2]
            order.append(best)
            left.remove(best)
        return cls(tuple(order), stats)

    def keeps(self, f: Facts) -> bool:
        return not any(rule.rejects(f) for rule in self.rules)

    def evaluated(self, f: Facts) -> int:
        """How many rules run on a text."""
        return next((n for n, rule in enumerate(self.rules, 1) if rule.rejects(f)), len(self.rules))


def fit_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> Cascade:
    """Costs and selectivities from at most sample_rows rows."""
    return Cascade.fitted([r[0] for r in docs.select("text").limit(sample_rows).collect()], rules)


def apply_rules(docs: DataFrame, cascade: Cascade, keep: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and kept (boolean) for every row."""
    return map_texts(docs, ["text"], lambda: lambda text: (cascade.keeps(Facts(text)),), "kept boolean", keep)


def keep_good(docs: DataFrame, cascade: Cascade) -> DataFrame:
    """The rows that no rule rejects, with their columns whatever their names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return apply_rules(rows, cascade, ["row"]).filter("kept").select("row.*")


def measure(cascade: Cascade) -> Callable[[str | None], tuple]:
    def one(text: str | None) -> tuple:
        f = Facts(text)
        base_failed = any(rule.rejects(f) for rule in BASE)
        return f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, base_failed, not base_failed and cascade.keeps(f)

    return one


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cascade = fit_cascade(docs)
    return map_texts(docs, ["text"], lambda: measure(cascade), "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean", ["doc_id"])


#: The rules in SQL; "letters" and "capitals" are Unicode classes there too.
ORACLE_SQL = {
    "op6_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
             w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(x, '[^\x09-\x0D\x1C-\x20\x{{85}}\p{{Z}}]+') AS u,
                          list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
             g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
             again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
             gaps AS (SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS n FROM again),
             repeats AS (SELECT r, sum(n)::BIGINT AS n_repeat_words FROM gaps GROUP BY r),
             f AS (SELECT w.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, len(regexp_extract_all(x, '[{SYMBOLS}]')) AS n_symbols,
                          len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                          len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stutters,
                          len(list_filter(u, lambda y: length(y) > 1 AND regexp_matches(y, '\p{{Lu}}') AND NOT regexp_matches(y, '[\p{{Ll}}\p{{Lt}}ªº]'))) AS upper,
                          len(list_filter(u, lambda y: regexp_matches(y, '\p{{L}}'))) AS alpha
                   FROM w LEFT JOIN repeats ON w.r = repeats.r),
             b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * stutters > 3 * n_words OR NOT word_chars BETWEEN 2 * n_words AND 20 * n_words
                    OR 10 * upper > 4 * greatest(n_words, 1) OR 10 * alpha < 7 * n_words) AS kept
        FROM b"""
}
