"""Text, digest and random-number functions as Columns; all stay in the JVM.

Composed normal form has no SQL function, but Spark ships the ICU library for its collations, and
``reflect`` calls its composer. Texts of ASCII characters are composed already and skip the call.
Spark takes a reflected call for nondeterministic, so it is made in a projection of its own, once per item
(``with_normal``), and everything else refers to the resulting columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tokens and the run length by which items are compared.
TOKEN_PATTERN = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"
SHINGLE = 3
DIGEST_PREFIX = "sha256:"
_UNIT = "\u001f"  # separates the parts of a digest's payload
_RECORD = "\u001e"


def compose(text: Column) -> Column:
    """Unicode composed form."""
    called = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(called)


def squeeze(text: Column) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalise_text(text: Column) -> Column:
    """Composed, white space squeezed; case and punctuation stay. Null stays null."""
    return F.when(text.isNotNull(), squeeze(compose(F.coalesce(text, F.lit("")))))


def normalise_choices(choices: Column) -> Column:
    """Every option in normal form; a null option counts as empty. The options are composed as one text,
    joined by a character that composition and ``squeeze`` leave alone."""
    joined = F.array_join(F.coalesce(choices, F.array().cast("array<string>")), "\u0001", "")
    return F.when(F.size(choices) > 0, F.transform(F.split(compose(joined), "\u0001"), squeeze)).otherwise(F.array().cast("array<string>"))


def with_normal(items: DataFrame) -> DataFrame:
    """Items with ``nq`` and ``nc``, their question and options in normal form."""
    return items.withColumns({"nq": F.coalesce(normalise_text(F.col("question")), F.lit("")), "nc": normalise_choices(F.col("choices"))})


def tokens(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits, with inner hyphens and apostrophes."""
    pattern = F.lit(f"({TOKEN_PATTERN})")
    return F.regexp_extract_all(F.lower(text), pattern, F.lit(1))


def item_tokens(question: Column, choices: Column) -> Column:
    """Tokens of the question and then of each option, as one sequence."""
    return F.concat(tokens(F.coalesce(question, F.lit(""))), F.coalesce(F.flatten(F.transform(choices, lambda c: tokens(F.coalesce(c, F.lit(""))))), F.array().cast("array<string>")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often lambdas in ``use`` refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(words: Column, width: int = SHINGLE) -> Column:
    """Distinct runs of ``width`` successive tokens; a shorter sequence is one run, an empty one none."""

    def runs(w: Column) -> Column:
        slid = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        short = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.when(F.size(w) >= width, slid).otherwise(short))

    return bound(words, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def digest(*parts: Column) -> Column:
    return F.concat(F.lit(DIGEST_PREFIX), F.sha2(F.concat_ws(_UNIT, *parts), 256))


def _length_marked(text: Column) -> Column:
    # lengths make the payload unambiguous whatever characters the texts hold
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def _joined(choices: Column) -> Column:
    return F.array_join(F.transform(choices, _length_marked), _RECORD, "null")


def stem_digest(question: Column, choices: Column) -> Column:
    """Identity of question and options, the key left out. Arguments in normal form."""
    return digest(F.lit("stem"), _length_marked(F.coalesce(question, F.lit(""))), _joined(choices))


def item_digest(question: Column, choices: Column, answer_index: Column) -> Column:
    """Identity of question, options and key; id and subject do not count."""
    return digest(F.lit("item"), _length_marked(F.coalesce(question, F.lit(""))), _joined(choices), answer_index.cast("string"))


def prompt_digest(scorer_id: str, question: Column, choices: Column) -> Column:
    """What a scorer's answer depends on: its identity, the question and the ordered options."""
    return digest(F.lit("prompt"), F.lit(scorer_id), _length_marked(F.coalesce(question, F.lit(""))), _joined(choices))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^{DIGEST_PREFIX}[0-9a-f]{{64}}$"), F.lit(False))


def uniform(seed: int, name: str, key: Column, slot: int | Column) -> Column:
    """A uniform number in [0, 1) that depends on (seed, name, key, slot) alone, never on the partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(name), key.cast("string"), F.lit(slot).cast("string") if isinstance(slot, int) else slot.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def longest_credit(choices: Column, answer_index: Column) -> Column:
    """1 / (number of longest options) if the key is one of them, else 0; lengths in code points."""
    return bound(
        F.transform(choices, lambda c: F.length(c)),
        lambda n: F.when(F.element_at(n, answer_index + 1) == F.array_max(n), 1.0 / F.size(F.filter(n, lambda x: x == F.array_max(n)))).otherwise(0.0),
    )


def longest_count(choices: Column) -> Column:
    return bound(F.transform(choices, lambda c: F.length(c)), lambda n: F.size(F.filter(n, lambda x: x == F.array_max(n))))


def tie_key(question: Column, option: Column) -> Column:
    """Decides ties between options without regard to their order; the least key wins."""
    return F.sha2(F.concat(question, F.lit("\u0000"), option), 256)


# Fixed value: options that can be named by a letter.
LETTERS = "".join(chr(ord("A") + k) for k in range(8))


def letter(index: Column) -> Column:
    return F.substring(F.lit(LETTERS), index + 1, F.lit(1)) if isinstance(index, Column) else F.lit(LETTERS[index])


def _asked(question: Column, present: Column, absent: Column) -> Column:
    return F.when(F.trim(F.coalesce(question, F.lit(""))) == "", absent).otherwise(present)


def labelled_prompt(question: Column, choices: Column) -> Column:
    """The question, if any, and one lettered line per option."""
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(". "), c)), "\n")
    return _asked(question, F.concat(question, F.lit("\n"), lines), lines)


LEAD_IN = "Complete with the right option:"  # what a cloze prompt begins with
GAP = "\n->"  # and what an option is written after


def cloze_prompt(question: Column) -> Column:
    """What an option continues when the options are not listed."""
    return _asked(question, F.concat(F.lit(f"{LEAD_IN}\n"), question, F.lit(GAP)), F.lit(LEAD_IN + GAP))


def parsed_reply(reply: Column, n_choices: Column) -> Column:
    """Index of the option a free reply names, or null.

    Labels are letters that stand alone. Those beyond the options are passed over; of the others
    the first one followed by one of ). : ] decides, or the first one if there is none.
    """
    alone = F.regexp_extract_all(F.translate(F.upper(reply), "_", " "), F.lit(rf"\b([{LETTERS}]\b[).:\]]?)"), F.lit(1))
    named = F.filter(alone, lambda x: F.instr(F.lit(LETTERS), F.substring(x, 1, 1)) <= n_choices)
    pick = F.coalesce(F.get(F.filter(named, lambda x: F.length(x) == 2), 0), F.get(named, 0))
    return F.instr(F.lit(LETTERS), F.substring(pick, 1, 1)) - 1


def label_index(label: Column, n_choices: Column) -> Column:
    """A letter or a number from 1 to a zero-based index; null where it names no option."""
    text = F.upper(F.trim(label))
    by_letter = F.when(F.length(text) == 1, F.instr(F.lit(LETTERS), text))
    number = F.coalesce(F.nullif(by_letter, F.lit(0)), F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int")))
    return F.when((number >= 1) & (number <= n_choices), number - 1)
