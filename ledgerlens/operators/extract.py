"""Labelled fields of policy documents, all documents at once.

Lines are unfolded together with their two successors, so the next-line rule
needs no window. Candidates are reduced per document, field and value before
they meet in one row per document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import values as v
from ledgerlens.functions.text import (
    LINE_END, SPACE, blank_to_null, clean_document_text, collapse, strip_chars, strip_space)

DELIMITERS = " \t:;|,"
DEFAULT_MINIMUM_CONFIDENCE = 0.75


@dataclass(frozen=True)
class FieldRule:
    name: str
    labels: list[str]
    kind: str
    confidence: float
    required: bool = False

    @property
    def starts(self) -> list[str]:
        """The first two letters of the label spellings, which are all plain letters."""
        words = [word for label in self.labels for word in (
            label[3:label.index(")")].split("|") if label.startswith("(?:") else [label])]
        return sorted({word[:2] for word in words})

    @property
    def pattern(self) -> str:
        joined = "|".join(f"(?:{label})" for label in self.labels)
        return rf"(?iU)^\s*(?:{joined})\s*(?:[:#=\-]|\bis\b)?\s*(.*?)\s*$"


# Label spellings and base confidences per field, in output order.
FIELD_RULES = [
    FieldRule("policy_number", [
        r"policy\s*(?:number|no\.?|#|id)",
        r"contract\s*(?:number|no\.?|#)",
        r"certificate\s*(?:number|no\.?|#)",
    ], "identifier", 0.99, True),
    FieldRule("customer_name", [
        r"(?:policyholder|insured|customer|member|subscriber)(?:\s+name)?",
    ], "person", 0.96, True),
    FieldRule("carrier_name", [
        r"carrier(?:\s+name)?",
        r"insurance\s+company",
        r"company\s+name",
        r"insurer",
    ], "plain", 0.94),
    FieldRule("plan_name", [
        r"plan(?:\s+name)?",
        r"product(?:\s+name)?",
        r"coverage\s+plan",
    ], "plain", 0.94),
    FieldRule("effective_date", [
        r"effective\s+date",
        r"policy\s+effective(?:\s+date)?",
        r"coverage\s+effective(?:\s+date)?",
        r"coverage\s+start(?:\s+date)?",
        r"start\s+date",
    ], "date", 0.97, True),
    FieldRule("termination_date", [
        r"termination\s+date",
        r"policy\s+end(?:\s+date)?",
        r"coverage\s+end(?:\s+date)?",
        r"end\s+date",
        r"cancel(?:lation)?\s+date",
    ], "date", 0.96),
    FieldRule("signature_date", [
        r"signature\s+date",
        r"signed\s+date",
        r"date\s+signed",
        r"application\s+signed(?:\s+date)?",
    ], "date", 0.96),
    FieldRule("premium", [
        r"premium(?:\s+amount)?",
        r"monthly\s+premium",
        r"annual\s+premium",
        r"policy\s+premium",
    ], "money", 0.97, True),
    FieldRule("policy_status", [
        r"policy\s+status",
        r"coverage\s+status",
        r"status",
    ], "status", 0.94),
]
# A policy number without a label, and its base confidence.
FALLBACK_PATTERN = (
    r"(?iu)(?<![A-Z0-9])((?:POLICY|CONTRACT|CERT|POL)[-\s]?(?=[A-Z0-9/_\-.]*\d)"
    r"[A-Z0-9][A-Z0-9/_\-.]{3,})(?![A-Z0-9])")
FALLBACK_CONFIDENCE = 0.90
NEXT_LINE_PENALTY = 0.02
FALLBACK_PENALTY = 0.15
METHOD_RANK = {"labeled_line": 3, "labeled_next_line": 2, "fallback_pattern": 1}

ANY_LABEL = rf"(?iU)^{SPACE}*(?:" + "|".join(
    f"(?:{label})" for rule in FIELD_RULES for label in rule.labels
).replace(r"\s", SPACE) + ")"

FIELD_NAMES = [rule.name for rule in FIELD_RULES]
# What a hit stands for if not for a rule, whose number it carries otherwise.
PAGE, FALLBACK = -1, -2
_FIELD_TYPE = ("struct<value:string,raw_value:string,found:boolean,page_number:int,"
               "page_id:bigint,source_text:string,confidence_score:double,"
               "extraction_method:string>")


def usable_pages(pages: DataFrame) -> DataFrame:
    """Completed pages with text that is not blank."""
    return pages.where((F.col("status") == "completed")
                       & (F.length(strip_space(F.col("text_content"))) > 0))


def confidence(base: Column, page: Column, next_line: Column, fallback: Column) -> Column:
    """Smaller of rule and page confidence, less the penalties, inside 0..1, four decimals."""
    score = (F.least(base, page)
             - F.when(next_line, NEXT_LINE_PENALTY).otherwise(0.0)
             - F.when(fallback, FALLBACK_PENALTY).otherwise(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 4)


def page_lines(pages: DataFrame, keep: list[str], only_labelled: bool = False) -> DataFrame:
    """One row per line: position, tidy text and the two lines after it.

    ``only_labelled`` keeps the first line of a page and those that begin with a label.
    """
    split = pages.select(*keep, F.split("cleaned", LINE_END).alias("lines"))

    def with_next(line: Column, i: Column) -> Column:
        return F.struct(line.alias("line"), F.get("lines", i + 1).alias("one"),
                        F.get("lines", i + 2).alias("two"))

    # the outer form, as the plain one adds a filter that would build the array twice
    unfolded = (split.withColumn("windows", F.transform("lines", with_next))
                .select(*keep, F.posexplode_outer("windows"))
                .select(*keep, F.col("pos").alias("line_no"), "col.*"))
    if only_labelled:
        # tested on the raw line, so other lines are not even tidied
        unfolded = unfolded.where((F.col("line_no") == 0) | F.col("line").rlike(ANY_LABEL))
    return unfolded.withColumn("line", collapse(F.col("line")))


def next_non_empty() -> Column:
    """The first of the two following lines that holds text, blanks stripped."""
    return F.coalesce(blank_to_null(strip_space(F.col("one"))),
                      blank_to_null(strip_space(F.col("two"))))


def fallback_match() -> Column:
    """First unlabelled policy number of a page: raw text and its surroundings.

    The match is found in the cleaned text, the surroundings are cut from the
    raw text at the same offsets.
    """
    return F.when(F.size("around_number") == 2, F.struct(
        F.col("number_raw").alias("raw"), v.policy_number(F.col("number_raw")).alias("value"),
        collapse(F.substring(
            F.col("text_content"), F.greatest(F.lit(0), F.col("number_lead") - 40) + 1,
            F.least(F.col("number_lead"), F.lit(40)) + F.length("number_raw") + 40))
        .alias("source_text")))


def with_fallback(pages: DataFrame) -> DataFrame:
    """Adds the cleaned text and the page's unlabelled policy number."""
    lead = F.length(F.get("around_number", F.lit(0)))
    tail = F.length(F.get("around_number", F.lit(1)))
    return (pages.withColumn("cleaned", clean_document_text(F.col("text_content")))
            .withColumn("around_number", F.when(
                F.col("cleaned").rlike("(?i)pol|contract|cert"),
                F.split("cleaned", FALLBACK_PATTERN, 2)))
            .withColumn("number_lead", lead)
            .withColumn("number_raw", F.substring(
                F.col("cleaned"), lead + 1, F.length("cleaned") - lead - tail))
            .withColumn("fallback", fallback_match()))


def _sql_pattern(pattern: str) -> str:
    """A regular expression as a raw SQL literal."""
    return f"r'{pattern}'"


def candidates(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """Every field candidate, every refused value, and one marker row per page."""
    keep = [document, "page_number", "page_id", "confidence_score", "fallback"]
    lines = page_lines(with_fallback(pages), keep, only_labelled=True)
    # written as SQL text: one expression per rule instead of a dozen calls each
    entries = [
        f"CASE WHEN line_no = 0 THEN named_struct('code', {PAGE}, 'raw', '') END",
        "CASE WHEN line_no = 0 AND fallback.value IS NOT NULL THEN "
        f"named_struct('code', {FALLBACK}, 'raw', fallback.raw) END"]
    # two letters spare most rules their expression; other scripts can fold to these letters
    bits: dict[str, int] = {}
    for number, rule in enumerate(FIELD_RULES):
        pattern = _sql_pattern(rule.pattern)
        for start in rule.starts:
            bits[start] = bits.get(start, 0) | 1 << number
        entries.append(
            f"CASE WHEN (near & {1 << number}) <> 0 AND line RLIKE {pattern} THEN "
            f"named_struct('code', {number}, 'raw', "
            f"trim(BOTH '{DELIMITERS}' FROM regexp_extract(line, {pattern}, 1))) END")
    near = (f"CASE WHEN start RLIKE '[^\\x00-\\x7f]' THEN {(1 << len(FIELD_RULES)) - 1} "
            + " ".join(f"WHEN start = '{start}' THEN {mask}" for start, mask in bits.items())
            + " ELSE 0 END")
    # a line hits few of the rules, so the others go before rows are made of them; named twice,
    # the array keeps a projection of its own, where it compiles (array_compact interprets)
    hits = (lines.withColumn("start", F.lower(F.substring("line", 1, 2)))
            .withColumn("near", F.expr(near))
            .withColumn("hits", F.expr(f"array({', '.join(entries)})"))
            .withColumn("hits", F.expr("CASE WHEN size(hits) > 0 THEN array_compact(hits) END"))
            .select("*", F.explode_outer("hits").alias("hit")).drop("hits", "near", "start")
            .where(F.col("hit").isNotNull()))

    code = F.col("code")
    is_fallback, is_label = code == FALLBACK, code >= 0
    from_next = (F.col("hit.code") >= 0) & (F.col("hit.raw") == "")
    follower = next_non_empty()
    raw = F.when(from_next, strip_chars(follower, DELIMITERS)).otherwise(F.col("hit.raw"))
    source = (F.when(F.col("hit.code") == FALLBACK, F.col("fallback.source_text"))
              .when(from_next, F.concat_ws("\n", "line", collapse(follower)))
              .otherwise(F.col("line")))
    found = hits.where(~from_next | follower.isNotNull()).select(
        document, "page_number", "page_id", "line_no", "hit.code", raw.alias("raw_value"),
        source.alias("source_text"), from_next.alias("from_next"), "confidence_score")

    rule_no = F.when(is_fallback, 0).otherwise(code)
    per_rule = lambda attribute, quote: F.expr(
        f"CASE code WHEN {FALLBACK} THEN {quote}{getattr(FIELD_RULES[0], attribute)}{quote} "
        + " ".join(f"WHEN {n} THEN {quote}{getattr(rule, attribute)}{quote}"
                   for n, rule in enumerate(FIELD_RULES)) + " END")
    prepared, value = F.col("raw_value"), F.lit(None).cast("string")
    for label, (prepare, finish) in v.NORMALISERS.items():
        numbers = [n for n, rule in enumerate(FIELD_RULES) if rule.kind == label]
        mine = code.isin(*numbers, *([FALLBACK] if 0 in numbers else []))
        if prepare:
            prepared = F.when(mine, prepare(F.col("raw_value"))).otherwise(prepared)
        value = F.when(mine, finish(F.col("prepared"))).otherwise(value)
    named = found.withColumn("prepared", prepared).withColumn("value", value)
    base = F.when(is_fallback, FALLBACK_CONFIDENCE).otherwise(
        per_rule("confidence", "").cast("double"))
    method = (F.when(is_fallback, "fallback_pattern")
              .when(is_label, F.when(F.col("from_next"), "labeled_next_line")
                    .otherwise("labeled_line")))
    refused = F.when(
        is_label & F.col("value").isNull(),
        F.concat(F.lit("Could not normalize "), per_rule("name", "'"), F.lit(" value '"),
                 F.col("raw_value"), F.lit("' on page "), F.col("page_number").cast("string"),
                 F.lit(".")))
    return named.select(
        document, F.when(is_label, "label").when(is_fallback, "fallback").otherwise("page")
        .alias("kind"), per_rule("name", "'").alias("field"), rule_no.alias("rule_no"), "value",
        "raw_value", "page_number", "page_id", "line_no", "source_text",
        method.alias("extraction_method"), refused.alias("warning"),
        F.when(F.col("value").isNotNull(), confidence(
            base, F.col("confidence_score"), F.col("from_next"), is_fallback))
        .alias("confidence_score"))


def _first_seen() -> Column:
    return F.struct("page_number", "page_id", "rule_no", "line_no")


def _preference() -> Column:
    """Smaller is better: confidence, then method, then earliest position."""
    rank = F.lit(0)
    for method, value in METHOD_RANK.items():
        rank = F.when(F.col("extraction_method") == method, value).otherwise(rank)
    return F.struct((-F.col("confidence_score")).alias("c"), (-rank).alias("m"),
                    F.col("page_number").alias("p"), F.col("page_id").alias("i"),
                    F.col("line_no").alias("l"))


def _evidence() -> Column:
    found = F.struct("value", "raw_value", F.lit(True).alias("found"), "page_number",
                     "page_id", "source_text", "confidence_score", "extraction_method")
    return F.struct(_preference().alias("rank"), found.alias("evidence"))


def best_candidates(found: DataFrame, document: str = "document_id") -> DataFrame:
    """One row per document and field value, combined map-side.

    A labelled value keeps its best evidence. A number without a label keeps the first,
    as only the first one can count.
    """
    rows = found.select(
        document, "rule_no", (F.col("kind") == "fallback").alias("is_fallback"), "value",
        "warning", _evidence().alias("best"), _first_seen().alias("seen"),
        (F.col("kind") == "page").cast("long").alias("pages"))
    keys = [document, "rule_no", "is_fallback", "value", "warning"]
    place = F.when(F.col("is_fallback"), F.col("seen"))
    return (rows.groupBy(*keys)
            .agg(F.min(F.struct(place.alias("place"), "best")).alias("least"),
                 F.min("seen").alias("seen"), F.sum("pages").alias("pages"))
            .select(*keys, F.col("least.best").alias("best"), "seen", "pages"))


def _values_of(rule_no: int) -> str:
    """SQL for the distinct values of one field, in the order the document shows them."""
    values = (f"transform(array_sort(filter(seen_values, x -> x.rule_no = {rule_no})), "
              "x -> x.value)")
    if rule_no == 0:
        values = f"concat(array_compact(array(fallback_value)), {values})"
    return f"array_distinct({values})"


def extract_documents(pages: DataFrame, document: str = "document_id",
                      minimum_confidence: float = DEFAULT_MINIMUM_CONFIDENCE) -> DataFrame:
    """One row per document: a struct per field, warnings, overall confidence.

    Candidates are first combined per value, so what meets in a document's row is bounded
    by its distinct values, whatever its number of pages.
    """
    if not 0 <= minimum_confidence <= 1:
        raise ValueError("minimum_confidence must be between 0 and 1")
    reduced = best_candidates(candidates(pages, document), document)
    labelled = "value IS NOT NULL AND NOT is_fallback"
    joined = reduced.groupBy(document).agg(
        *[F.expr(f"min(best) FILTER (WHERE {labelled} AND rule_no = {n})").alias(f"best_{n}")
          for n in range(len(FIELD_RULES))],
        F.expr("min(struct(seen, best)) FILTER (WHERE is_fallback)").alias("fallback"),
        F.expr(f"min(seen) FILTER (WHERE {labelled} AND rule_no = 0)").alias("first_label"),
        F.expr(f"collect_list(struct(rule_no, seen, value)) FILTER (WHERE {labelled})")
        .alias("seen_values"),
        F.expr("collect_list(struct(seen, warning)) FILTER (WHERE warning IS NOT NULL)")
        .alias("refused"),
        F.sum("pages").cast("int").alias("page_count"))

    # the unlabelled number counts only where no label came up to its page
    place = lambda s: F.struct(s["page_number"], s["page_id"])
    stands = F.col("fallback").isNotNull() & (
        F.col("first_label").isNull()
        | (place(F.col("first_label")) > place(F.col("fallback.seen"))))
    joined = joined.withColumn("fallback", F.when(stands, F.col("fallback")))
    chosen = {n: F.col(f"best_{n}") for n in range(len(FIELD_RULES))}
    chosen[0] = F.least(F.col("best_0"), F.col("fallback.best"))
    absent = F.from_json(F.lit('{"found": false}'), _FIELD_TYPE)
    fields = joined.select(
        document, "page_count", "seen_values", "refused",
        F.col("fallback.best.evidence.value").alias("fallback_value"),
        *[F.coalesce(chosen[n]["evidence"].cast(_FIELD_TYPE), absent).alias(rule.name)
          for n, rule in enumerate(FIELD_RULES)])

    fields = fields.withColumns({f"shown_{n}": F.expr(_values_of(n))
                                 for n in range(len(FIELD_RULES))})
    notes = []
    for n, rule in enumerate(FIELD_RULES):
        name = rule.name
        notes.append(
            f"CASE WHEN size(shown_{n}) > 1 THEN concat('Conflicting values found for {name}: ', "
            f"array_join(shown_{n}, ', '), '. Selected ', {name}.value, ' from page ', "
            f"CAST({name}.page_number AS STRING), '.') END")
        notes.append(
            f"CASE WHEN {name}.confidence_score < {minimum_confidence}D THEN concat('Low-confidence "
            f"extraction for {name}: ', format_string('%.2f', {name}.confidence_score), '.') END")
        if rule.required:
            notes.append(f"CASE WHEN NOT {name}.found THEN "
                         f"'Required field {name} was not found.' END")
    warnings = F.expr("array_distinct(concat(transform(array_sort(refused), x -> x.warning), "
                      f"array_compact(array({', '.join(notes)}))))")
    scores = F.array_compact(F.array(*[F.col(name)["confidence_score"] for name in FIELD_NAMES]))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return fields.select(
        document, "page_count", *FIELD_NAMES, warnings.alias("warnings"),
        F.when(F.size(scores) > 0, F.round(mean, 4)).otherwise(F.lit(0.0))
        .alias("document_confidence"))


def flat_fields(extraction: DataFrame, document: str = "document_id") -> DataFrame:
    """One row per document and field."""
    entries = [F.struct(F.lit(name).alias("field_name"), F.col(name).alias("f"))
               for name in FIELD_NAMES]
    return (extraction.select(document, F.explode(F.array(*entries)).alias("e"))
            .select(document, "e.field_name", "e.f.*"))


def presence(c: Column) -> Column:
    """Trimmed value, null when blank."""
    return blank_to_null(strip_space(c))
