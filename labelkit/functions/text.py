"""String, label-list and prompt-text columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelkit.functions.binding import let

# The answer format a label predictor is asked for, and the default label.
LABEL_LIST_PATTERN = r"\[([\d,\s]+)\]"
STOP_MARK = "@"
SAFE_LABEL = "safe"
SAFE_CATEGORY = "Safe Content"

WHITE_SPACE = " \t\n\x0b\f\r"


def _col(sel: str | Column) -> Column:
    return F.col(sel) if isinstance(sel, str) else sel


def _empty_labels() -> Column:
    return F.array().cast("array<string>")


def strip(sel: str | Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.btrim(_col(sel), F.lit(WHITE_SPACE))


def squeeze(sel: str | Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_col(sel)), r"\s+", " "))


def parse_labels(sel: str | Column, require_stop: bool = True, safe_fallback: bool = True) -> Column:
    """Numeric label list in an answer such as ``[3, 7]@ confidence 80%``.

    Without a list the result is ``["safe"]`` when the text speaks of "safe", else empty.
    ``require_stop=False`` also takes lists whose stop mark was already cut off.
    """
    text = F.coalesce(_col(sel), F.lit(""))
    pattern = LABEL_LIST_PATTERN + (STOP_MARK if require_stop else "")
    found = F.transform(F.split(F.regexp_extract(text, pattern, 1), ","), strip)
    otherwise = _empty_labels()
    if safe_fallback:
        otherwise = F.when(
            F.contains(F.lower(text), F.lit(SAFE_LABEL)), F.array(F.lit(SAFE_LABEL))
        ).otherwise(otherwise)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(otherwise)


def strip_stop(sel: str | Column, stop: str = STOP_MARK) -> Column:
    """Drop one trailing stop mark, then outer white space. Parse labels before this."""
    text = _col(sel)
    cut = F.when(F.endswith(text, F.lit(stop)), F.left(text, F.length(text) - len(stop))).otherwise(text)
    return strip(cut)


def format_ok(sel: str | Column) -> Column:
    """1.0 when the answer states a confidence in percent, else 0.0."""
    text = F.coalesce(_col(sel), F.lit(""))
    return (F.contains(text, F.lit("confidence")) & F.contains(text, F.lit("%"))).cast("double")


def label_set_score(predicted: Column, expected: Column, compliance: Column | float = 1.0) -> Column:
    """compliance * (0.6 * first label hit + 0.4 * F1 of the label sets)."""
    compliance = compliance if isinstance(compliance, Column) else F.lit(float(compliance))
    none = _empty_labels()
    predicted = F.coalesce(predicted, none)
    expected = F.coalesce(expected, none)
    first_hit = F.coalesce(
        F.array_contains(expected, F.get(predicted, F.lit(0))), F.lit(False)
    ).cast("double")
    shared = F.size(F.array_intersect(predicted, expected))
    n_pred = F.size(F.array_distinct(predicted))
    n_true = F.size(F.array_distinct(expected))
    # 2PR/(P+R) with P = shared/n_pred and R = shared/n_true is 2*shared/(n_pred+n_true)
    f1 = F.when(shared > 0, 2.0 * shared / (n_pred + n_true)).otherwise(0.0)
    return compliance * (0.6 * first_hit + 0.4 * f1)


def label_score(answer: str | Column, expected: Column) -> Column:
    """Score of a raw answer against the expected label list; 0 when no list can be read."""
    predicted = parse_labels(answer, safe_fallback=False)
    return label_set_score(predicted, expected, format_ok(answer))


def join_labels(labels: str | Column) -> Column:
    return F.array_join(_col(labels), ", ")


def split_labels(sel: str | Column) -> Column:
    """Labels of a comma-joined string, stripped, empty parts dropped; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(_col(sel), F.lit("")), ","), strip)
    return F.filter(parts, lambda x: x != "")


def label_set(sel: str | Column, safe: str = SAFE_CATEGORY, compat: bool = False) -> Column:
    """Distinct labels of a joined string, where "no label" and the safe label are the same set.

    By default an empty list stands for the safe label, and the safe label beside others is
    dropped.  ``compat=True`` takes the labels as they stand.
    """
    labels = F.array_distinct(split_labels(sel))
    if compat:
        return labels
    return let(
        F.filter(labels, lambda x: x != safe),
        lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(safe))),
    )


def predicted_label_set(sel: str | Column, safe: str = SAFE_CATEGORY, compat: bool = False) -> Column:
    """As ``label_set``; with ``compat`` only an answer that is exactly the safe label is emptied."""
    if not compat:
        return label_set(sel, safe)
    text = _col(sel)
    return label_set(F.when(text == safe, F.lit("")).otherwise(text), safe, compat=True)


def same_labels(left: Column, right: Column) -> Column:
    """Set equality of two label lists."""
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))


def parse_category_line(
    sel: str | Column,
    categories: Sequence[str],
    prompt: str | Column | None = None,
    default: str = SAFE_CATEGORY,
) -> Column:
    """First line of a response that names a known category, stripped.

    ``prompt`` is cut off the front first when the response repeats it.
    """
    text = F.coalesce(_col(sel), F.lit(""))
    if prompt is not None:
        head = F.lit(prompt) if isinstance(prompt, str) else prompt
        text = F.when(F.startswith(text, head), F.substr(text, F.length(head) + 1)).otherwise(text)

    def names_one(line: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in categories])

    hit = strip(F.get(F.filter(F.split(text, "\n"), names_one), F.lit(0)))
    return F.when(hit != "", hit).otherwise(F.lit(default))


def onehot_conf(labels: Column, categories: Sequence[str]) -> Column:
    """Map of every category to 1.0 or 0.0."""
    known = F.array(*[F.lit(c) for c in categories])
    values = F.transform(known, lambda c: F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("double"))
    return F.map_from_arrays(known, values)


def split_prompts(sel: str | Column) -> Column:
    """Prompts held in one generated answer.

    Lines that start with "Prompt" and hold a colon give the text after the first colon; an answer
    without such lines is cut at blank lines.
    """
    text = F.coalesce(_col(sel), F.lit(""))
    lines = F.filter(
        F.split(text, "\n"),
        lambda x: F.startswith(x, F.lit("Prompt")) & F.contains(x, F.lit(":")),
    )
    bodies = F.transform(lines, lambda x: strip(F.substr(x, F.instr(x, ":") + 1)))
    return let(bodies, lambda b: F.when(F.size(b) > 0, b).otherwise(F.split(strip(text), "\n\n")))


def unescape_newlines(sel: str | Column) -> Column:
    return F.replace(_col(sel), F.lit("\\n"), F.lit("\n"))


def run_stamp(ts: Column | None = None) -> Column:
    """``20240131_235959``, for names of run outputs."""
    return F.date_format(ts if ts is not None else F.current_timestamp(), "yyyyMMdd_HHmmss")


def iso_stamp(ts: Column | None = None) -> Column:
    return F.date_format(
        ts if ts is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )


def has_extension(path: str | Column, extensions: Sequence[str]) -> Column:
    """File name ends in one of the extensions, whatever its case."""
    return F.lower(_col(path)).rlike(r"\.(" + "|".join(e.lower().lstrip(".") for e in extensions) + ")$")


def exact_match(pred: str | Column, gold: str | Column) -> Column:
    """1.0 when both answers are the same text up to case and white space."""
    return F.coalesce(squeeze(pred) == squeeze(gold), F.lit(False)).cast("double")


def reward(pred: str | Column, gold: str | Column) -> Column:
    """+1 for a right label, -1 for a wrong or missing one."""
    return F.when(_col(pred) == _col(gold), 1).otherwise(-1)


def coalesce_nonempty(*sels: str | Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(s), F.lit("")) for s in sels])


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100.0 * part / whole, digits)
