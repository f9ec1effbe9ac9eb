"""Text-quality expressions over recognised lines: every builder takes a Column and returns a Column, without UDFs
except for Unicode composition (`nfc`), which Spark has no function for.

Patterns follow the rules of recognised Vietnamese text: the letter range U+00C0..U+1EF9 counts as letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that make a capital token, and the characters that recognised text may hold.
CAPITALS = "A-ZĐÁÀẢÃẠÂẤẦẨẪẬĂẮẰẲẴẶÉÈẺẼẸÊẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÚÙỦŨỤƯỨỪỬỮỰÝỲỶỸỴ"
EXPECTED = r"A-Za-zÀ-ỹ0-9\s.,;:!?()\[\]{}\x27\x22\-—–_/«»“”‘’"
NUMBER = r"[0-9]{1,2}[/-][0-9]{1,2}([/-][0-9]{2,4})?|[0-9]{4}|[0-9]{1,3}([.,][0-9]{1,3})+|[0-9]+[A-Za-zÀ-ỹ]?|[A-Za-zÀ-ỹ]?[0-9]+"
STRIPPED = ".,;:!?()[]{}\"'"
COMBINING = r"[̀-ͯ]"
#: What (?U)\s stands for, and what begins a run of it that isn't one space already.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_RUNS = r"(?U)[^\S ]\s*| \s+"


def nfc(column: Column) -> Column:
    """Unicode composition, by Arrow batches."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(run, "string")(column)


def composed(df: DataFrame, name: str) -> DataFrame:
    """df with column `name` composed: only rows that hold combining marks pass through Python."""
    marked = F.coalesce(F.col(name).rlike(COMBINING), F.lit(False))
    return df.where(~marked).unionByName(df.where(marked).withColumn(name, nfc(F.col(name))))


def spaced(column: Column) -> Column:
    """White space runs as one space, none at the ends; null as empty. (The input is taken as composed.)"""
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), _RUNS, " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_controls(column: Column) -> Column:
    """Control and format characters deleted (tabs and line ends among them), then `spaced`."""
    return spaced(F.regexp_replace(F.coalesce(column, F.lit("")), r"[\p{Cc}\p{Cf}]", ""))


def safe_lines(column: Column) -> Column:
    """Blanks collapsed within lines, every line trimmed; line ends and characters stay."""
    t = F.regexp_replace(F.coalesce(column, F.lit("")), r"[ \t\r\f\x0B]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def tokens(column: Column) -> Column:
    return F.filter(F.split(spaced(column), " "), lambda x: x != "")


def _count(column: Column, pattern: str) -> Column:
    return F.regexp_count(column, F.lit(pattern))


def suspicious_tokens(column: Column) -> Column:
    """Tokens that mix letters with digits, stripped of punctuation, unless they are numbers, dates or codes of one letter."""
    both = F.filter(F.split(spaced(column), " "), lambda x: x.rlike("[A-Za-zÀ-ỹ]") & x.rlike(r"(?U)\d"))
    bare = F.transform(both, lambda x: F.btrim(x, F.lit(STRIPPED)))
    return F.filter(
        bare,
        lambda x: (x != "")
        & ~x.rlike(rf"^(?:{NUMBER})$")
        & (F.length(F.regexp_replace(x, r"\P{L}", "")) >= 2)
        & (F.length(F.regexp_replace(x, r"(?U)\D", "")) >= 1),
    )


def digit_count(column: Column) -> Column:
    return _count(F.coalesce(column, F.lit("")), r"(?U)\d")


def digits_of(words: Column) -> Column:
    return F.length(F.regexp_replace(F.array_join(words, ""), r"(?U)\D", ""))


def suspicious_digits(column: Column) -> Column:
    """Digits inside suspicious tokens."""
    return digits_of(suspicious_tokens(column))


def digit_noise_rate(column: Column) -> Column:
    n = digit_count(column)
    return F.when(n > 0, suspicious_digits(column) / n).otherwise(0.0)


def abnormal_symbols(column: Column) -> Column:
    return _count(spaced(column), rf"(?U)[^{EXPECTED}]")


def visible_chars(column: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)\s", ""))


def abnormal_rate(column: Column) -> Column:
    n = visible_chars(column)
    return F.when(n > 0, abnormal_symbols(column) / n).otherwise(0.0)


def capital_tokens(column: Column) -> Column:
    return F.regexp_extract_all(spaced(column), F.lit(rf"(?U)\b[{CAPITALS}]{{2,}}\b"), F.lit(0))


def capital_rate(column: Column) -> Column:
    n = F.size(tokens(column))
    return F.when(n > 0, F.size(capital_tokens(column)) / n).otherwise(0.0)


def repeated_numbers(column: Column) -> Column:
    """Runs of four or more 0/1, then runs of five or more digits that aren't among them, each once."""
    t = spaced(column)
    binary = F.regexp_extract_all(t, F.lit("[01]{4,}"), F.lit(0))
    return F.concat(binary, F.array_except(F.regexp_extract_all(t, F.lit(r"(?U)\d{5,}"), F.lit(0)), binary))


def repeated_count(column: Column) -> Column:
    """How many repeated numbers a whole text has."""
    return F.when(column.rlike(r"\p{Nd}{4}"), F.size(repeated_numbers(column))).otherwise(0)


def is_garbage(column: Column) -> Column:
    """Empty, without letters and digits, mostly digits or punctuation, mostly capitals, or at most two characters."""
    t = F.btrim(F.coalesce(column, F.lit("")), F.lit(SPACES))

    def capitals(t: Column) -> Column:
        parts = F.split(t, r"(?U)\s+")
        caps = F.filter(parts, lambda x: (F.length(x) >= 2) & (x == F.upper(x)) & (x != F.lower(x)))
        # what has a lower case is of one of these classes, and each such word has one at least
        signs = _count(t, r"[\p{Lu}\p{Lt}\p{Nl}\p{So}]")
        return F.when(signs < 0.6 * (1 + _count(t, r"(?U)\s+")), F.lit(False)).otherwise(F.size(caps) / F.size(parts) > 0.65)

    def judged(t: Column) -> Column:
        digits = F.when(t.rlike(r"\p{Nd}"), _count(t, r"(?U)\d")).otherwise(0)
        # by runs, as most of a text is letters
        letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}++", ""))
        return let(F.array(letters, digits), lambda n: _judged(t, n[0], n[1], capitals))

    return let(t, judged)


def _judged(t: Column, letters: Column, digits: Column, capitals: Callable[[Column], Column]) -> Column:
    return (
        F.when((F.length(t) <= 2) | (letters + digits == 0), F.lit(True))
        .when(digits / (letters + digits) > 0.55, F.lit(True))
        # marks are neither letters, numbers nor space: no more than what is left
        .when((F.length(t) - letters - digits > 0.34 * F.length(t)) & (_count(t, r"[^\p{L}\p{N}\s]") / F.length(t) > 0.35), F.lit(True))
        .otherwise((letters > 8) & capitals(t))
    )


def is_hallucinated(column: Column) -> Column:
    return (F.length(F.coalesce(column, F.lit(""))) > 0) & (
        (F.size(capital_tokens(column)) >= 1)
        | (F.size(repeated_numbers(column)) >= 1)
        | (abnormal_rate(column) > 0.05)
        | (F.size(suspicious_tokens(column)) >= 1)
    )


def label_reason(column: Column, least: int, vocabulary: str) -> Column:
    """Why a label is no training label: empty, too_short, non_vocab_chars, non_vietnamese_script; or ok.

    `vocabulary`: the characters allowed, as the inside of a character class.
    """
    t = F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)^\s+|\s+$", "")
    foreign = r"[一-鿿㐀-䶿Ѐ-ӿ؀-ۿ฀-๿぀-ヿ가-힯]"
    return (
        F.when(t == "", "empty")
        .when(F.length(t) < least, "too_short")
        .when(t.rlike(f"[^{vocabulary}]"), "non_vocab_chars")
        .when(t.rlike(foreign), "non_vietnamese_script")
        .otherwise("ok")
    )


def slug(column: Column, longest: int = 80) -> Column:
    t = F.regexp_replace(F.lower(F.trim(column)), "[^a-z0-9]+", "-")
    t = F.regexp_replace(t, "^-+|-+$", "")
    return F.when(t == "", "paper").otherwise(F.regexp_replace(F.substring(t, 1, longest), "-+$", ""))


def title_key(column: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(column)), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9 ]+", ""))


def paper_id(doi: Column, arxiv: Column, title: Column, year: Column) -> Column:
    """Twelve hex digits of a hash of the best key there is: doi, then arxiv, then title and year."""
    key = (
        F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("doi:"), F.lower(F.trim(doi))))
        .when(F.coalesce(arxiv, F.lit("")) != "", F.concat(F.lit("arxiv:"), F.lower(F.trim(arxiv))))
        .otherwise(F.concat(F.lit("title:"), title_key(title), F.lit("|year:"), F.coalesce(year.cast("string"), F.lit(""))))
    )
    return F.substring(F.sha1(key), 1, 12)


def source_of(path: Column) -> Column:
    """The part of a file name before two underscores, else unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("__"), F.element_at(F.split(name, "__"), 1)).otherwise("unknown")


def source_family(path: Column, families: tuple[str, ...], rest: str = "crawled") -> Column:
    """The first family whose name starts the file name."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.when(F.lit(False), "")
    for f in families:
        out = out.when(name.startswith(f), f)
    return out.otherwise(rest)


def without_id_prefix(stem: Column) -> Column:
    return F.regexp_replace(stem, r"^\d+_", "")


def json_object(column: Column) -> Column:
    """What stands between the first { and the last }."""
    return F.regexp_extract(column, r"(?s)\{.*\}", 0)


def length_bucket(column: Column) -> Column:
    """short [0, 30), medium [30, 80), long [80, 999), else unknown."""
    return F.when((column >= 0) & (column < 30), "short").when((column >= 30) & (column < 80), "medium").when((column >= 80) & (column < 999), "long").otherwise("unknown")


def resized_width(width: Column, height: Column, to: int) -> Column:
    """The width at height `to`, rounded up to tens, ten at least."""
    return F.greatest(F.ceil((width * to / height).cast("int") / 10) * 10, F.lit(10)).cast("long")


def has_diacritic(column: Column) -> Column:
    """A letter outside the plain Latin ones of the expected range."""
    return column.rlike("^[À-ỹ]$") & column.rlike(r"^\p{L}$")


def first_tag(tags: Column, known: tuple[str, ...], rest: str = "Other") -> Column:
    """The first of the tags that is known (trimmed, in lower case)."""
    low = F.transform(tags, lambda x: F.lower(F.trim(x)))
    return F.coalesce(F.get(F.filter(low, lambda x: x.isin(*known)), F.lit(0)), F.lit(rest))


def joined_names(names: Column) -> Column:
    """Names, trimmed, that aren't empty, joined by '; '; null where there is none."""
    kept = F.filter(F.transform(names, F.trim), lambda x: x != "")
    return F.nullif(F.array_join(kept, "; "), F.lit(""))


def ticks_to_usd(ticks: Column) -> Column:
    return F.coalesce(ticks, F.lit(0)) / F.lit(1e10)
