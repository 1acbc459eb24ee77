"""Text functions as Columns.

Java's ``(?U)\\s`` covers the Unicode blanks; U+3000 is one of them. NFKC has no built-in function, so it is an Arrow UDF, and rows
that are plain ASCII don't get there.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"(?U)[\s　]+"
ENDS = r"(?U)^[\s　]+|[\s　]+$"
#: Fixed value: punctuation that a candidate may not begin or end with.
EDGE = " ,，;；:：、·.。-—"
#: Fixed value: terms too general to describe anything.
GENERIC_TERMS = ("备用", "设备", "部件", "阀", "泵", "电机", "开关", "柜", "模块", "测试", "未知", "暂无", "待定")
PLACEHOLDERS = ("test", "xxx", "n/a", "na", "none", "null", "-", "--", "待定", "未知", "暂无")
CJK = "一-鿿"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def strip(col: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(col, ENDS, "")


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def first_non_blank(*cols: Column) -> Column:
    """The first of the columns that isn't null or blank, stripped."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def default_label(col: Column, label: str = "未分类") -> Column:
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit(label))


def nfkc(col: Column) -> Column:
    # Python gets nulls for ASCII rows: a condition around a UDF alone would not keep them from it.
    other = col.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfkc(F.when(other, col))).otherwise(col)


def collapse(col: Column) -> Column:
    """Runs of blanks to one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, BLANK, " "))


def normalize(col: Column, mode: str) -> Column:
    """whitespace, nfkc, nfkc_whitespace, candidate, identity, metadata, comparison or fact."""
    if mode == "whitespace":
        return collapse(col)
    if mode == "nfkc":
        return nfkc(col)
    if mode == "nfkc_whitespace":
        return collapse(nfkc(col))
    if mode == "candidate":
        edge = f"[{EDGE.replace('-', '')}\\-]"
        return F.regexp_replace(collapse(nfkc(F.coalesce(col, F.lit("")))), f"^{edge}+|{edge}+$", "")
    if mode == "identity":
        return F.regexp_replace(F.replace(F.lower(nfkc(col)), F.lit("ß"), F.lit("ss")), f"[^0-9a-z{CJK}]", "")
    if mode == "metadata":
        return F.upper(collapse(nfkc(F.coalesce(col, F.lit("")))))
    if mode == "comparison":
        return F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), f"[^0-9A-Za-z{CJK}]", ""))
    if mode == "fact":
        return F.lower(collapse(F.coalesce(col, F.lit(""))))
    raise ValueError(f"no normalisation {mode}")


def metadata_key(*cols: Column) -> Column:
    return F.concat_ws("|", *[normalize(c, "metadata") for c in cols])


def ngrams(col: Column, n: int = 2) -> Column:
    """Distinct n-grams; a shorter text is its own, an empty one has none."""
    size = F.length(col)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(col, i, F.lit(n))))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(col)).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def terms(col: Column, stop: tuple[str, ...] = GENERIC_TERMS) -> Column:
    """Distinct 2- to 4-grams with a CJK character, without the general terms, in order."""
    grams = F.concat(*[F.when(F.length(col) >= n, ngrams(col, n)).otherwise(F.array().cast("array<string>")) for n in (2, 3, 4)])
    return F.array_sort(F.array_distinct(F.filter(grams, lambda x: x.rlike(f"[{CJK}]") & ~x.isin(*stop))))


def number_skeleton(col: Column, mask: str = "<NUM>") -> Column:
    return F.regexp_replace(col, r"[0-9]+(\.[0-9]+)?", mask.replace("{", r"\{").replace("}", r"\}") if "{" in mask else mask)


def code_shape(col: Column) -> Column:
    """Digits to 9, letters to A, all else to X, of the upper-case text."""
    out = F.regexp_replace(F.upper(col), r"\p{Nd}", "9")
    return F.regexp_replace(F.regexp_replace(out, r"\p{L}", "A"), "[^9A]", "X")


def alpha_tokens(col: Column) -> Column:
    """(token, offset, length) of each run of A to Z, offsets from 0."""
    text = F.coalesce(col, F.lit(""))
    found = F.regexp_extract_all(text, F.lit("([A-Z]+)"), F.lit(1))
    gaps = F.split(text, "[A-Z]+")
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.when(i > 0, F.slice(found, 1, i)).otherwise(F.array().cast("array<string>")), F.lit(0), lambda a, t: a + F.length(t)))
    pairs = F.transform(found, lambda t, i: F.struct(t.alias("token"), F.get(at, i).alias("offset"), F.length(t).alias("length")))
    return pairs


def kks_like(col: Column, kind: str = "strict") -> Column:
    """Three tests that the sources use: a long code within the text, a whole code, or letters with digits."""
    if kind == "strict":
        return col.rlike("[0-9][0-9A-Z]{10,16}")
    if kind == "prefixed":
        return col.rlike("^[0-9]{2}[A-Za-z0-9]+$")
    if kind == "mixed":
        return (F.length(col) >= 6) & col.rlike("[A-Za-z]") & col.rlike("[0-9]")
    raise ValueError(f"no code test {kind}")


#: Full-width forms and what they become.
FULLWIDTH = str.maketrans("０１２３４５６７８９＃", "0123456789#")
PUNCTUATION = ("（），／－＋：；", "(),/-+:;")


def map_chars(col: Column, source: str, target: str) -> Column:
    return F.translate(col, source, target)


def format_text(col: Column) -> Column:
    """Full-width punctuation to ASCII, U+3000 to a blank, runs of ASCII blanks to one, none at the ends."""
    out = F.replace(F.translate(col, *PUNCTUATION), F.lit("　"), F.lit(" "))
    return strip(F.regexp_replace(out, " {2,}", " "))


def space_pattern(col: Column) -> Column:
    """Names of the blanks at fault, joined by a plus; empty where none is."""
    found = (("leading", r"^[\s　]"), ("trailing", r"[\s　]$"), ("ideographic", "　"), ("multiple", r"[^\s] {2,}[^\s]"), ("control", r"[\t\r\n]"))
    return F.concat_ws("+", *[F.when(col.rlike(rx), F.lit(name)) for name, rx in found])


def risk_flags(col: Column) -> Column:
    """Marks whose loss would change meaning."""
    found = (("roman_numeral", "[Ⅰ-Ⅻⅰ-ⅻ]"), ("question_mark", r"[?？]"), ("temperature_unit", "[℃℉]"), ("circled_digit", "[①-⑳]"), ("signed_number", r"(^|[^0-9A-Za-z])[-+][0-9]"))
    return F.array_compact(F.array(*[F.when(col.rlike(rx), F.lit(name)) for name, rx in found]))


def question_position(col: Column) -> Column:
    """interior_single, interior_multiple, boundary or none, by where question marks stand."""
    text = strip(col)
    marks = F.length(F.regexp_replace(text, "[^?？]", ""))
    return F.when(marks == 0, "none").when(text.rlike("^[?？]|[?？]$"), "boundary").when(marks == 1, "interior_single").otherwise("interior_multiple")


def parse_time(col: Column) -> Column:
    """ISO text to a timestamp; naive times are UTC, what can't be read is null."""
    return F.try_to_timestamp(F.nullif(strip(col), F.lit("")))


def safe_float(col: Column, default: float | None = None) -> Column:
    """A finite number, or the default."""
    x = col.try_cast("double")
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")) | x.isNull(), F.lit(default).cast("double")).otherwise(x)


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(col, F.lit(high)), F.lit(low))


def unit_form(col: Column) -> Column:
    return F.replace(col, F.lit("KV"), F.lit("kV"))


def is_code_only(col: Column) -> Column:
    return col.rlike("^[A-Za-z0-9_.:/-]+$")


def is_generic(col: Column) -> Column:
    return col.isin(*GENERIC_TERMS)


def is_placeholder(col: Column) -> Column:
    text = F.lower(strip(F.coalesce(col, F.lit(""))))
    return (text == "") | text.isin(*PLACEHOLDERS) | text.rlike("^x{3,}$|^test")


def _mapping_group(c: str) -> str:
    name = unicodedata.name(c, "")
    if "ROMAN NUMERAL" in name:
        return "roman"
    if "CIRCLED" in name:
        return "circled"
    if "FULLWIDTH" in name:
        return "fullwidth"
    return "punctuation" if unicodedata.category(c).startswith("P") else "other"


@F.pandas_udf(T.StringType())
def mapping_group(text: pd.Series) -> pd.Series:
    """Kinds of the characters that NFKC changes, sorted, joined by a plus."""

    def one(x: str) -> str:
        return "+".join(sorted({_mapping_group(c) for c in x if unicodedata.normalize("NFKC", c) != c}))

    return text.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def changed_codepoints(text: pd.Series) -> pd.Series:
    """``U+XXXX(name)>form`` of each character that NFKC changes, sorted and distinct."""

    def one(x: str) -> str:
        return "; ".join(sorted({f"U+{ord(c):04X}({unicodedata.name(c, '')})>{n}" for c in x if (n := unicodedata.normalize("NFKC", c)) != c}))

    return text.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def mapping_signature(source: pd.Series, target: pd.Series) -> pd.Series:
    """Sorted distinct ``U+XXXX->form`` that turn the source into the target; else ``contextual_or_composed_change``."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        table = {c: unicodedata.normalize("NFKC", c) for c in a}
        if "".join(table[c] for c in a) != b:
            return "contextual_or_composed_change"
        return ",".join(sorted({f"U+{ord(c):04X}->{n}" for c, n in table.items() if n != c}))

    return pd.Series([one(a, b) for a, b in zip(source, target, strict=True)])


@F.pandas_udf(T.StringType())
def edit_script(source: pd.Series, target: pd.Series) -> pd.Series:
    """The changes that turn one text into the other, as ``kind:from->to`` joined by bars."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        steps = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        return "|".join(f"{kind}:{a[i:j]}->{b[k:m]}" for kind, i, j, k, m in steps if kind != "equal")

    return pd.Series([one(a, b) for a, b in zip(source, target, strict=True)])


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all, to four places: the ratio of longest matching blocks, not an edit distance."""
    return pd.Series([None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a, b, strict=True)], dtype="float64")


_mapped = "".join(map(chr, FULLWIDTH)), "".join(map(chr, FULLWIDTH.values()))


def fullwidth_digits(col: Column) -> Column:
    return F.translate(col, *_mapped)
