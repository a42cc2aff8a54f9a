"""Typed rows out of delivered CSV records; records that fail come out with the reason.

Every field is loaded as nullable text, all rules run as column expressions that fill an array of errors, and
a row is good if that array is empty. There is no regular expression over whole records with nested
repetition, so records of any length parse without deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import strip_space

HEADER = "id,qid1,qid2,question1,question2,is_duplicate"
_CUT, _ESC = "\ue000", "\ue001"  # a field border in the rewritten record, and what escapes it in the text


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "a")), F.lit(_CUT), F.lit(_ESC + "b"))


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESC + "b"), F.lit(_CUT)), F.lit(_ESC + "a"), F.lit(_ESC))


def _middle(pieces: Column) -> Column:
    """The pieces between the first and the last; those at even places stand inside quotes."""
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))


def quoting_ok(pieces: Column) -> Column:
    """``pieces``: the record split at every quote, so pieces at odd places stand inside quotes.

    A piece outside is empty only at the ends or between the two quotes of a doubled one; else it must end with a
    comma where a quote follows, and begin with one where a quote precedes.
    """
    first, last = F.get(pieces, F.lit(0)), F.element_at(pieces, -1)
    # every second piece is inside: marked by place, so that no lambda looks at the whole array
    outside = F.filter(_middle(pieces), lambda _, i: i % 2 == 1)
    between = F.forall(outside, lambda p: (p == "") | (p.startswith(",") & p.endswith(",")))
    ends = ((first == "") | first.endswith(",")) & ((last == "") | last.startswith(","))
    return (F.size(pieces) == 1) | ((F.size(pieces) % 2 == 1) & ends & between)


def record_fields(pieces: Column) -> Column:
    """The fields of a record with correct quoting."""
    first, last = F.get(pieces, F.lit(0)), F.element_at(pieces, -1)
    cut = lambda p: F.replace(_escaped(p), F.lit(","), F.lit(_CUT))
    middle = F.transform(_middle(pieces), lambda p, i: F.when(i % 2 == 0, _escaped(p)).when(p == "", F.lit('"')).otherwise(cut(p)))
    text = F.when(F.size(pieces) == 1, cut(first)).otherwise(F.concat(cut(first), F.array_join(middle, ""), cut(last)))
    return F.transform(F.split(text, _CUT, -1), _plain)


def broken_rules(fields: Column, quoted: Column, width: int) -> list[tuple[str, Column]]:
    """(name, condition) of every rule, in the order in which a record's first reason counts; a null condition isn't an error.

    The fields are compared with what they become as typed values: an id is all ASCII digits, a label casts to 0 or 1 and is written so.
    """
    id_, question1, label = (F.get(fields, F.lit(i)) for i in (0, 3, 5))
    bare = strip_space(label)
    aligned = quoted & (F.size(fields) == width)
    return [
        ("quoting", ~quoted),
        ("column_count", quoted & (F.size(fields) != width)),
        ("value:id", aligned & ~id_.rlike("\\A[0-9]+\\z")),
        ("value:question1", aligned & (strip_space(question1) == "")),
        ("value:is_duplicate", aligned & ~F.coalesce(bare.try_cast("tinyint").isin(0, 1) & (F.length(bare) == 1), F.lit(False))),
    ]


def parse_pair_records(raw: DataFrame, line: str = "raw_line", header: str = HEADER) -> DataFrame:
    """``raw`` with ``_errors`` (array of all broken rules: empty for a good record) and the six fields as text.

    Rules are quoting, column_count, value:id, value:question1, value:is_duplicate; fields are only looked at where their number is right.
    Nulls: a null record is an empty one (column_count). Header lines, also repeated ones, are left out; a
    carriage return at the end is part of the line ending. Extra columns of ``raw`` stay. Missing qids and question2 are fine and
    come out null. An empty table gives an empty one.
    """
    text = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), "\\r\\z", "")
    step = raw.withColumn("_text", text).where(F.col("_text") != header).withColumn("_pieces", F.split("_text", '"', -1))
    step = step.withColumn("_quoted", quoting_ok(F.col("_pieces")))
    step = step.withColumn("_fields", F.when(F.col("_quoted"), record_fields(F.col("_pieces"))))
    names = header.split(",")
    step = step.withColumns({f"_{name}": F.get("_fields", F.lit(i)) for i, name in enumerate(names)})
    # bound in a lambda, so the optimizer can't copy the splitting of a record into every rule
    both = F.array(F.struct(F.col("_quoted").alias("quoted"), F.col("_fields").alias("fields")))
    rules = lambda r: F.array(*[F.when(broken, name) for name, broken in broken_rules(r["fields"], r["quoted"], len(names))])
    errors = F.get(F.transform(both, rules), F.lit(0))
    return step.withColumn("_errors", F.array_compact(errors)).drop("_text", "_pieces", "_quoted", "_fields")


def failed_records(parsed: DataFrame, key: str = "raw_id") -> DataFrame:
    """(key, reason) of the records with errors: the first broken rule, quoting, column_count or value."""
    return parsed.where(F.size("_errors") > 0).select(key, F.split_part(F.get("_errors", F.lit(0)), F.lit(":"), F.lit(1)).alias("reason"))


def valid_pairs(parsed: DataFrame, key: str = "raw_id") -> DataFrame:
    """The good records as typed rows of pairs, with their key.

    ``row_id`` is null for an id that no long can hold; such an id stands in ``long_id`` as text.
    """
    blank = lambda name: F.when(F.col(name) != "", F.col(name))
    return parsed.where(F.size("_errors") == 0).select(
        key,
        F.col("_id").try_cast("long").alias("row_id"),
        F.when(F.col("_id").try_cast("long").isNull(), F.col("_id")).alias("long_id"),
        blank("_qid1").alias("qid1"),
        blank("_qid2").alias("qid2"),
        F.col("_question1").alias("question1"),
        blank("_question2").alias("question2"),
        strip_space(F.col("_is_duplicate")).cast("int").alias("is_duplicate"),
    )
