"""Quality rules: a learned decision list over text statistics, in DataFrame functions only.

The statistics are built-in functions over arrays of words and lines. From those of labelled documents, sequential
covering learns rules for low quality: a rule grows by the threshold condition of the largest information gain on
two thirds of the rows that no earlier rule covers, its last conditions are pruned where that does better on the
other third, and it is taken if it is precise enough there. Each rule becomes a branch of one conditional
expression, in the order learned; what no branch takes is kept.

Cases: null text has no words and lines. Rows without doc_id and repeated rows are judged like others; a doc_id that
is labelled more than once is fitted on with each label. An empty table gives no rows. Without labels the list is
empty and only the base rules decide. Equal gains go to the first statistic and the smallest threshold. Other
columns are ignored; ``judge`` replaces those with a name of its own, ``keep_good`` leaves all as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows to fit on, at most.
MAX_FIT = 10000
#: Of a list: rules, conditions of a rule, thresholds tried for a statistic; of a rule on the rows held back: precision, rows.
RULES, CONDITIONS, THRESHOLDS, PRECISION, SUPPORT = 12, 4, 32, 0.9, 5
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
SYMBOLS, UPPER, DIGITS, MARKS = "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?"
#: What the rules test: statistics that don't grow with a text's length, but for the number of words itself.
TESTED = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share")


def let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated(words: Column, n: Column) -> Column:
    """Words in 5-word windows found twice or more. Hashes tell whether there are any; the windows themselves, which."""
    at = F.sequence(F.lit(1), n - 4)
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i, 5)))
    windows = F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i, 5), " ").alias("w"), i.alias("i"))))

    def covered(ordered):
        same = lambda x, k: F.coalesce(F.get(ordered, k)["w"] == x["w"], F.lit(False))
        starts = F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: F.sequence(x["i"], x["i"] + 4))
        return F.size(F.array_distinct(F.flatten(starts)))

    return F.when(n < 6, 0).when(F.size(F.array_distinct(hashes)) == n - 4, 0).otherwise(let(windows, covered)).cast("long")


def statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with the base columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the columns TESTED."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = documents.withColumn("_text", whole).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "_lines": lines})
    out = out.withColumns(
        {
            "word_chars": F.length(F.regexp_replace("_text", SPACE + "+", "")).cast("long"),
            "n_symbols": _count(F.col("_text"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeated(F.col("_words"), F.size("_words")),
            "_n_lines": F.size("_lines"),
            "_distinct": F.size(F.array_distinct("_words")),
            "_upper": _count(F.col("_text"), UPPER),
            "_digits": _count(F.col("_text"), DIGITS),
            "_marks": _count(F.col("_text"), MARKS),
        }
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = out.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "_n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("_upper", "word_chars"),
            "digit_share": share("_digits", "word_chars"),
            "mark_share": share("_marks", "word_chars"),
            "distinct_share": share("_distinct", "n_words"),
        }
    )
    return out.drop("_text", "_words", "_lines", "_n_lines", "_distinct", "_upper", "_digits", "_marks")


Condition = tuple[str, bool, float]  # a statistic, whether it is above, a threshold


def _holds(x: np.ndarray, conditions: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in conditions:
        own = x[:, TESTED.index(name)]
        out &= own > cut if above else own <= cut
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < CONDITIONS and (~bad & inside).any() and (p := (bad & inside).sum()):
        base, best = np.log2(p / inside.sum()), (1e-9, None)
        for name in TESTED:
            own = x[:, TESTED.index(name)]
            for cut in np.unique(np.quantile(own[inside], np.linspace(0, 1, THRESHOLDS + 1)[:-1], method="lower")):
                for above in (True, False):
                    chosen = inside & (own > cut if above else own <= cut)
                    if hit := (bad & chosen).sum():
                        gain = hit * (np.log2(hit / chosen.sum()) - base)
                        if gain > best[0]:
                            best = (gain, (name, above, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _holds(x, rule)
    return rule


def learn(x: np.ndarray, bad: np.ndarray) -> list[list[Condition]]:
    """An ordered list of rules for bad rows; x has a column for each of TESTED."""
    rules: list[list[Condition]] = []
    left = np.ones(len(x), bool)
    held = np.arange(len(x)) % 3 == 2
    while len(rules) < RULES and (bad & left & ~held).any():
        rule = _grow(x[left & ~held], bad[left & ~held])
        own_x, own_bad = x[left & held], bad[left & held]

        def worth(conditions: list[Condition]) -> float:
            inside = _holds(own_x, conditions)
            p, n = (own_bad & inside).sum(), (~own_bad & inside).sum()
            return (p - n) / (p + n) if p + n else -1.0

        kept = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])
        inside = _holds(own_x, kept) if kept else np.zeros(len(own_x), bool)
        if inside.sum() < SUPPORT or (own_bad & inside).sum() < PRECISION * inside.sum():
            break
        rules.append(kept)
        left &= ~_holds(x, kept)
    return rules


def fit(documents: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> list[list[Condition]]:
    """Learns from at most max_fit rows of labels (doc_id, quality 0 or 1): those of the smallest hash of doc_id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_fit)
    rows = statistics(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("doc_id", "quality", *TESTED).collect()
    rows = sorted(map(tuple, rows))
    x = np.array([r[2:] for r in rows], float).reshape(-1, len(TESTED))
    return learn(x, np.array([r[1] == 0 for r in rows], bool))


def expression(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that takes a row, from 1, or null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for name, above, cut in rule:
            test = test & (F.col(name) > F.lit(cut) if above else F.col(name) <= F.lit(cut))
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def judge(documents: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """documents with the base columns, base_failed, rule (the number of the rule that took the row) and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = statistics(documents).withColumns({"base_failed": base, "rule": expression(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*TESTED[1:])


def keep_good(documents: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The rows of documents that ``judge`` keeps, with all their columns, whatever their names."""
    held = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("_row"), "text")
    return judge(held, rules).filter("kept").select("_row.*")
