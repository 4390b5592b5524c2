"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition that rejects and the features it needs.  What each costs and how many it
rejects is measured on a bounded sample; rules then stand in order of rejections per cost, and
a CASE stops at the first that rejects.  The order decides what is computed, never the verdict.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words per window of the repetition rule.
WINDOW = 8
#: Rows at most that order the rules.
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the features named in ``needs`` (SQL text)."""

    name: str
    rejects: str
    needs: tuple[str, ...]


def _repeats(words: str) -> str:
    """SQL for the words that lie in a window of WINDOW words found twice or more.

    Windows are compared by a 64-bit hash; where all differ nothing else is done.  Otherwise they
    are sorted by hash and place, the places of equal neighbours stay, and each covers the words up
    to the next such place, WINDOW at most.
    """
    parts = ", ".join(f"{words}[j + {k}]" for k in range(WINDOW))
    hashes = f"transform(sequence(0, size({words}) - {WINDOW}), j -> xxhash64({parts}))"
    sort = "array_sort(transform(h, (x, j) -> struct(x as v, j as j)))"
    equal = "(i > 0 and s[i - 1].v = x.v) or (i + 1 < size(s) and s[i + 1].v = x.v)"
    places = f"array_sort(transform(filter(s, (x, i) -> {equal}), x -> x.j))"
    covered = f"transform(p, (j, i) -> if(i + 1 < size(p), least({WINDOW}, p[i + 1] - j), {WINDOW}))"
    total = f"aggregate({covered}, 0L, (a, x) -> a + x)"
    let = "transform(array({value}), {name} -> {body})[0]"
    inner = let.format(value=sort, name="s", body=let.format(value=places, name="p", body=total))
    body = f"if(size(array_distinct(h)) = size(h), 0L, {inner})"
    return f"if(size({words}) < {WINDOW}, 0L, {let.format(value=hashes, name='h', body=body)})"


#: feature -> SQL over ``_text``, ``_words`` and ``_lines``.
FEATURES = {
    "n_words": "cast(size(_words) as bigint)",
    "word_chars": "cast(length(array_join(_words, '')) as bigint)",
    "n_symbols": "cast(regexp_count(_text, '[#*$%&|<>]') as bigint)",
    "n_dup_lines": "cast(size(_lines) - size(array_distinct(_lines)) as bigint)",
    "n_lines": "cast(size(_lines) as bigint)",
    "n_repeat_words": _repeats("_words"),
}

BASE_RULES = (
    Rule("few words", "n_words < 20", ("n_words",)),
    Rule("repeated windows", "100 * n_repeat_words > 30 * n_words", ("n_words", "n_repeat_words")),
)
#: The method's own rules besides the base ones: each is far outside of what prose has.
RULES = (
    *BASE_RULES,
    Rule("symbols", "n_symbols > 0.25 * n_words", ("n_words", "n_symbols")),
    Rule("repeated lines", "n_lines >= 4 and n_dup_lines > 0.3 * n_lines", ("n_lines", "n_dup_lines")),
    Rule("word length", "word_chars < 2 * n_words or word_chars > 20 * n_words", ("n_words", "word_chars")),
)


#: The text, its words and its lines that hold a word (SQL over ``text``); nulls are empty.
PARTS = {
    "t": "coalesce(text, '')",
    "w": "array_remove(split(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), '')",
    "l": "filter(split(coalesce(text, ''), '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')",
}


def with_parts(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns _text, _words and _lines."""
    return docs.withColumns({"_text": F.expr(PARTS["t"]), "_words": F.expr(PARTS["w"]), "_lines": F.expr(PARTS["l"])})


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second of work on ``rows`` documents, most first.

    Any documents serve, as the order changes no verdict; ties and an empty table keep the given order.
    """
    sample = stored(docs.select("text").limit(rows), "rule-sample")
    ranked = []
    for place, rule in enumerate(rules):
        began = time.perf_counter()
        tested = with_parts(sample).select(*[F.expr(FEATURES[f]).alias(f) for f in rule.needs])
        rejected = tested.agg(F.sum(F.when(F.expr(rule.rejects), 1).otherwise(0))).first()[0] or 0
        ranked.append((-rejected / (time.perf_counter() - began), place, rule))
    return [rule for _, _, rule in sorted(ranked, key=lambda x: x[:2])]


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule rejects; later rules are not looked at once one does."""
    chain = F.when(F.expr(rules[0].rejects), F.lit(False))
    for rule in rules[1:]:
        chain = chain.when(F.expr(rule.rejects), F.lit(False))
    return chain.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the features, base_failed and kept of every row.

    A null or empty text has no words and fails.  Repeated rows and null ids stay as they are;
    other columns are ignored; no rows give no rows.
    """
    order = ordered_rules(docs, tuple(r for r in rules if r not in BASE_RULES))
    rows = with_parts(docs.select("doc_id", "text"))
    rows = rows.select("doc_id", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()])
    failed = F.expr(" or ".join(f"({r.rejects})" for r in BASE_RULES))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(order))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *names)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns kept; one pass, each feature only if reached."""
    order = ordered_rules(docs, rules)
    cases = " ".join(f"when {_over_parts(rule)} then false" for rule in order)
    parts = "named_struct('t', {t}, 'w', {w}, 'l', {l})".format(**PARTS)
    return docs.where(F.expr(f"transform(array({parts}), d -> case {cases} else true end)[0]"))


def _over_parts(rule: Rule) -> str:
    """A rule's condition over a struct ``d`` of text, words and lines, so that each is made once a row."""
    rejects = rule.rejects
    for name in rule.needs:
        feature = FEATURES[name].replace("_text", "d.t").replace("_words", "d.w").replace("_lines", "d.l")
        rejects = re.sub(rf"\b{name}\b", lambda _, f=feature: f"({f})", rejects)
    return rejects
