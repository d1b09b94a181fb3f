"""Segment and document rules.

All segment rules are projections around one generator, without a shuffle. Asking for few rules
builds only those.
"""

from __future__ import annotations

from collections.abc import Iterable
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.functions.ordered import with_previous
from cueflow.functions.text import one_decimal, strip

ISSUE_COLUMNS = [
    "doc_id", "segment_idx", "issue_type", "severity", "message", "details",
    "phase", "pos", "rule_no", "line_no",
]


def duration_ms() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def cps() -> Column:
    """Characters per second; 0 without duration, negative for a negative one."""
    return F.when(duration_ms() == 0, F.lit(0.0)).otherwise(
        F.length("text") / (F.when(duration_ms() != 0, duration_ms()) / F.lit(1000.0))
    )


def default_thresholds() -> dict[str, Column]:
    names = ["min_duration_ms", "max_duration_ms", "max_cps", "line_wrap"]
    return {n: F.lit(K.DEFAULT_SETTINGS[n]) for n in names}


def issue_message(issue_type: str, **values: Column | str) -> Column:
    """The message of an issue with its placeholders filled."""
    parts = []
    for literal, name, _, _ in Formatter().parse(K.MESSAGES[issue_type]):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = values[name]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts)


def _details(**values: Column) -> Column:
    if not values:
        return F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<string>")
        )
    pairs = [item for k, v in values.items() for item in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs)


class SegmentRules:
    """The rules on single segments as expressions over (idx, start_ms, end_ms, text).

    Rows only carry which rule broke on which line; severity, message and details are worked out
    from that afterwards, so whatever a caller does not read is never computed.
    """

    # name -> place in the report (both line rules share one, their lines order them).
    ORDER = {
        "duration_too_short": 1, "duration_short": 2, "duration_too_long": 3, "duration_long": 4,
        "cps_too_high": 5, "cps_high": 6, "empty_text": 7, "too_many_lines": 8,
        "line_too_long": 9, "line_long": 9, "negative_start": 10, "invalid_timing": 11,
    }
    LINE_RULES = ("line_too_long", "line_long")
    ERRORS = (
        "duration_too_short", "duration_too_long", "cps_too_high", "empty_text",
        "negative_start", "invalid_timing",
    )
    ERRORS_IF_STRICT = ("too_many_lines", "line_too_long")

    def __init__(self, limits: dict[str, Column] | None = None, strict: bool = False):
        self.limits = {**default_thresholds(), **(limits or {})}
        self.errors = set(self.ERRORS) | (set(self.ERRORS_IF_STRICT) if strict else set())
        self.names = list(self.ORDER)

    def conditions(self) -> dict[str, Column]:
        """Condition of each rule on whole segments."""
        length, speed = duration_ms(), cps()
        too_short = length < K.MIN_SEGMENT_MS
        too_long = length > K.MAX_SEGMENT_MS
        too_fast = speed > F.lit(K.HARD_MAX_CPS)
        return {
            "duration_too_short": too_short,
            "duration_short": ~too_short & (length < self.limits["min_duration_ms"]),
            "duration_too_long": too_long,
            "duration_long": ~too_long & (length > self.limits["max_duration_ms"]),
            "cps_too_high": too_fast,
            "cps_high": ~too_fast & (speed > self.limits["max_cps"]),
            "empty_text": strip(F.col("text")) == "",
            "too_many_lines": self.line_count() > K.MAX_LINES,
            "negative_start": F.col("start_ms") < 0,
            "invalid_timing": F.col("end_ms") <= F.col("start_ms"),
        }

    def line_count(self) -> Column:
        return F.size(F.split("text", "\n", -1))

    def line_condition(self, name: str, size: Column) -> Column:
        over = size > K.MAX_LINE_CHARS
        return over if name == "line_too_long" else ~over & (size > self.limits["line_wrap"])

    def broken(self, wanted: set[str]) -> Column:
        """array<struct<rule, line>> of the broken rules; `line` is 0 for whole segments."""

        def hit(name: str, line: Column) -> Column:
            return F.struct(
                F.lit(self.names.index(name)).alias("rule"), line.cast("int").alias("line")
            )

        arrays = []
        whole = [
            F.when(condition, hit(name, F.lit(0)))
            for name, condition in self.conditions().items() if name in wanted
        ]
        if whole:
            arrays.append(F.filter(F.array(*whole), lambda h: h.isNotNull()))

        def check(line: Column, i: Column) -> Column:
            out = None
            for name in self.LINE_RULES:
                if name in wanted:
                    test = self.line_condition(name, F.length(line))
                    out = (F.when if out is None else out.when)(test, hit(name, i + 1))
            return out

        if wanted & set(self.LINE_RULES):
            lines = F.transform(F.split("text", "\n", -1), check)
            arrays.append(F.filter(lines, lambda h: h.isNotNull()))
        return arrays[0] if len(arrays) == 1 else F.concat(*arrays)

    def tally(self, errors: bool) -> Column:
        """Number of broken rules that are errors (or warnings) in one segment."""
        total = F.lit(0)
        for name, condition in self.conditions().items():
            if (name in self.errors) == errors:
                total = total + condition.cast("int")
        counted = [n for n in self.LINE_RULES if (n in self.errors) == errors]
        if not counted:
            return total

        def breaks_one(line: Column) -> Column:
            tests = [self.line_condition(n, F.length(line)) for n in counted]
            return tests[0] if len(tests) == 1 else tests[0] | tests[1]

        # The two line rules exclude each other, so a line counts once.
        return total + F.size(F.filter(F.split("text", "\n", -1), breaks_one))

    def _pick(self, rule: Column, values: dict[str, Column]) -> Column:
        out = None
        for name, value in values.items():
            test = rule == self.names.index(name)
            out = (F.when if out is None else out.when)(test, value)
        return out

    def severity(self, rule: Column) -> Column:
        errors = [self.names.index(n) for n in self.names if n in self.errors]
        return F.when(rule.isin(errors), F.lit("error")).otherwise(F.lit("warning"))

    def _line_size(self, line: Column) -> Column:
        return F.length(F.get(F.split("text", "\n", -1), line - 1))

    def message(self, rule: Column, line: Column) -> Column:
        length, limits = duration_ms(), self.limits
        values = {
            "duration": length, "cps": one_decimal(F.length("text"), F.when(length > 0, length)),
            "lines": self.line_count(), "line": line, "size": self._line_size(line),
        }
        bounds = {
            "duration_too_short": str(K.MIN_SEGMENT_MS), "duration_short": limits["min_duration_ms"],
            "duration_too_long": str(K.MAX_SEGMENT_MS), "duration_long": limits["max_duration_ms"],
            "cps_too_high": str(K.HARD_MAX_CPS), "cps_high": limits["max_cps"],
            "too_many_lines": str(K.MAX_LINES), "line_too_long": str(K.MAX_LINE_CHARS),
            "line_long": limits["line_wrap"],
        }
        return self._pick(rule, {
            name: issue_message(name, bound=bounds.get(name, ""), **values) for name in self.names
        })

    def details(self, rule: Column, line: Column) -> Column:
        length = _details(duration_ms=duration_ms())
        speed = _details(cps=cps())
        lines = _details(line_number=line, line_length=self._line_size(line))
        return self._pick(rule, {
            "duration_too_short": length, "duration_short": length,
            "duration_too_long": length, "duration_long": length,
            "cps_too_high": speed, "cps_high": speed,
            "empty_text": _details(),
            "too_many_lines": _details(line_count=self.line_count()),
            "line_too_long": lines, "line_long": lines,
            "negative_start": _details(start_ms=F.col("start_ms")),
            "invalid_timing": _details(start_ms=F.col("start_ms"), end_ms=F.col("end_ms")),
        })


def segment_issues(
    segments: DataFrame,
    names: Iterable[str] | None = None,
    limits: dict[str, Column] | None = None,
    strict: bool = False,
) -> DataFrame:
    """One row per broken rule. `limits` may name columns, for thresholds per document."""
    rules = SegmentRules(limits, strict)
    wanted = set(names) if names is not None else set(rules.names)
    rule, line = F.col("rule"), F.col("line")
    places = F.array(*[F.lit(n) for n in rules.ORDER.values()])
    titles = F.array(*[F.lit(n) for n in rules.names])
    return segments.select("*", F.inline(rules.broken(wanted))).select(
        "doc_id", F.col("idx").alias("segment_idx"), F.get(titles, rule).alias("issue_type"),
        rules.severity(rule).alias("severity"), rules.message(rule, line).alias("message"),
        rules.details(rule, line).alias("details"), F.lit(1).alias("phase"), "pos",
        F.get(places, rule).alias("rule_no"), line.alias("line_no"),
    )


def _issue(name, severity, rule_no, message, details) -> Column:
    return F.struct(
        F.lit(name).alias("issue_type"), F.lit(severity).alias("severity"),
        message.alias("message"), details.alias("details"),
        F.lit(rule_no).alias("rule_no"), F.lit(0).alias("line_no"),
    )


def out_of_order() -> Column:
    return F.col("start_ms") < F.col("prev_start_ms")


def large_gap() -> Column:
    return F.col("start_ms") - F.col("prev_end_ms") > K.GAP_MS


def order_issues(segments: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Starts before the previous segment, and gaps over ten seconds."""
    wanted = set(names) if names is not None else {"out_of_order", "large_gap"}
    linked = with_previous(
        segments.select("doc_id", "pos", "idx", "start_ms", "end_ms"),
        ["doc_id"], "pos", ["idx", "start_ms", "end_ms"],
    )
    gap = F.col("start_ms") - F.col("prev_end_ms")
    found = []
    if "out_of_order" in wanted:
        found.append(F.when(
            out_of_order(),
            _issue(
                "out_of_order", "error", 1,
                issue_message(
                    "out_of_order", current=F.col("idx"), previous=F.col("prev_idx")),
                _details(
                    current_start=F.col("start_ms"), previous_start=F.col("prev_start_ms")),
            ),
        ))
    if "large_gap" in wanted:
        found.append(F.when(
            large_gap(),
            _issue(
                "large_gap", "warning", 2,
                issue_message(
                    "large_gap", gap=gap, previous=F.col("prev_idx"), current=F.col("idx")),
                _details(gap_ms=gap),
            ),
        ))
    issues = F.filter(F.array(*found), lambda issue: issue.isNotNull())
    return (
        linked.select("doc_id", "pos", F.col("idx").alias("segment_idx"), F.inline(issues))
        .withColumn("phase", F.lit(3))
        .select(*ISSUE_COLUMNS)
    )


def overlap_issues(pairs: DataFrame) -> DataFrame:
    """Issue rows for overlapping pairs; the positions stand in the segment slot, 0-based."""
    return pairs.select(
        "doc_id", F.col("pos_i").alias("segment_idx"),
        F.lit("overlap").alias("issue_type"), F.lit("error").alias("severity"),
        issue_message("overlap", first=F.col("pos_i"), second=F.col("pos_j")).alias("message"),
        _details(overlapping_segments=F.array("pos_i", "pos_j")).alias("details"),
        F.lit(2).alias("phase"), F.col("pos_i").alias("pos"), F.lit(1).alias("rule_no"),
        F.col("pos_j").cast("int").alias("line_no"),
    )


def document_issue(docs: DataFrame, issue_type: str, message: Column) -> DataFrame:
    return docs.select(
        "doc_id", F.lit(None).cast("long").alias("segment_idx"),
        F.lit(issue_type).alias("issue_type"), F.lit("error").alias("severity"),
        message.alias("message"), _details().alias("details"), F.lit(0).alias("phase"),
        F.lit(0).cast("long").alias("pos"), F.lit(1).alias("rule_no"), F.lit(0).alias("line_no"),
    )


def empty_document_issues(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """The single issue of documents that have no segment at all."""
    empty = docs.select("doc_id").join(segments.select("doc_id").distinct(), "doc_id", "left_anti")
    return document_issue(empty, "empty_document", issue_message("empty_document"))


def ordered_issues(issues: DataFrame) -> DataFrame:
    """Issues in report order."""
    return issues.orderBy("doc_id", "phase", "pos", "rule_no", "line_no")


def issue_side(severity: Column) -> Column:
    return F.when(severity == "error", F.lit("errors")).otherwise(F.lit("warnings"))
