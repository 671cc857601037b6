"""Line-first quality rules, in SQL functions only.

Each line is judged alone: it must end in terminal punctuation, hold few symbols, not shout in
capitals or in runs of exclamation marks, be no navigation bar and say no boilerplate phrase. Lines
that fail are removed; a document that loses more than half of its text is rejected, as is one that
fails the base rules on words and repetition. All work is per row: no shuffle, whole texts.

Defined results: null and empty texts have no words, no lines and fail; a document that loses just half of its
text stays; texts of any length are judged whole; repeated rows are judged each; an empty table gives no rows;
other columns, whatever their names, are ignored by ``judge`` and kept as they are by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfactor.llm.common import fresh

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a document's characters in removed lines above which it is rejected.
MAX_LOST = 0.5

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
TERMINAL = r"""[.!?…。！？]["'»”’)\]]*[\x20\x09-\x0D]*$"""
SHOUT = r"[!?]{2,}"
NAVIGATION = r"[\x20\x09][|>»›·•][\x20\x09]"
#: Phrases of English, German, French and Spanish pages; they begin and end in ASCII letters, where all engines see word borders.
BOILERPLATE = r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses cookies|enable javascript|click here|sign (in|up)|log in|subscribe to|skip to (main )?content|back to top|lorem ipsum|alle rechte vorbehalten|verwendet cookies|hier klicken|zum seitenanfang|tous droits r.serv.s|utilise des cookies|cliquez ici|haut de page|todos los derechos reservados|utiliza cookies|haga clic|iniciar sesi.n)\b"


def line_passes(line: str) -> str:
    """SQL that also DuckDB understands, given ``regexp_count`` and ``regexp_like``."""
    return " and ".join(
        (
            f"regexp_like({line}, '{quoted(TERMINAL)}')",
            f"20 * regexp_count({line}, '{SYMBOL}') <= length({line})",
            f"regexp_count({line}, '{SHOUT}') < 3",
            rf"2 * regexp_count({line}, '\\p{{Lu}}') <= length({line})",
            f"regexp_count({line}, '{NAVIGATION}') < 3",
            f"not regexp_like({line}, '{quoted(BOILERPLATE)}')",
        )
    )


def quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def measured(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the base counts, verdicts and the texts of all lines and of those that pass; and the names of these columns, which no column of ``docs`` has."""
    n = {c: fresh(docs, c) for c in ("words", "windows", "sorted", "places", "found", "good_lines", "lines", "good", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
    space, word, text = quoted(SPACE), quoted(WORD), "coalesce(text, '')"
    out = docs.withColumn(n["words"], F.expr(f"array_remove(split({text}, '{space}+'), '')"))
    out = out.withColumn(n["found"], F.expr(f"filter(split({text}, '\\n', -1), l -> regexp_like(l, '{word}'))"))
    w = n["words"]
    window = lambda made: f"transform(slice({w}, 1, size({w}) - 2), (x, i) -> {made})"
    out = out.withColumn(n["windows"], F.expr(f"case when size({w}) > 2 then {window(f'xxhash64(x, {w}[i + 1], {w}[i + 2])')} else array() end"))
    # Only texts in which hashes of windows repeat sort the windows themselves; equal neighbours give the places.
    own = window(f"struct(array(x, {w}[i + 1], {w}[i + 2]) as h, i as i)")
    out = out.withColumn(n["sorted"], F.expr(f"case when size(array_distinct({n['windows']})) < size({n['windows']}) then array_sort({own}) end"))
    twice = f"coalesce(x.h = get({n['sorted']}, i - 1).h, false) or coalesce(x.h = get({n['sorted']}, i + 1).h, false)"
    out = out.withColumn(n["places"], F.expr(f"sort_array(transform(filter({n['sorted']}, (x, i) -> {twice}), x -> x.i))"))
    covered = f"aggregate({n['places']}, struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)"
    out = out.withColumns(
        {
            n["good_lines"]: F.expr(f"filter({n['found']}, l -> {line_passes('l')})"),
            n["n_words"]: F.size(w).cast("long"),
            n["word_chars"]: F.length(F.array_join(w, "")).cast("long"),
            n["n_symbols"]: F.expr(f"cast(regexp_count({text}, '{SYMBOL}') as long)"),
            n["n_dup_lines"]: (F.size(n["found"]) - F.size(F.array_distinct(n["found"]))).cast("long"),
            n["n_repeat_words"]: F.coalesce(F.expr(covered), F.lit(0).cast("long")),
        }
    )
    out = out.withColumns({n["lines"]: F.length(F.array_join(n["found"], "")), n["good"]: F.length(F.array_join(n["good_lines"], ""))})
    out = out.withColumn(n["base_failed"], (F.col(n["n_words"]) < MIN_WORDS) | (100 * F.col(n["n_repeat_words"]) > MAX_REPEAT_PERCENT * F.col(n["n_words"])))
    return out.withColumn(n["kept"], ~F.col(n["base_failed"]) & (F.col(n["lines"]) - F.col(n["good"]) <= MAX_LOST * F.col(n["lines"]))), n


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept."""
    found, _ = measured(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; ``text`` has the lines that pass."""
    found, n = measured(docs)
    return found.where(n["kept"]).select(*(F.array_join(n["good_lines"], "\n").alias(c) if c.lower() == "text" else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
