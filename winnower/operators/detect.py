"""Rule scoring of paragraphs and runs, and the decision what to remove."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.text import all_hits, first_hit, lowered, nonblank, once
from winnower.rules import DEFAULT, SECTIONS, Rules

THRESHOLD = 0.5
DETECTION = "struct<ord:int,content_type:string,confidence:double,reason:string>"

#: A detector of one's own: gets the element's columns and gives confidence and reason; null confidence: nothing found.
Custom = tuple[str, Callable[["Element"], tuple[Column, Column]]]


class Element:
    """The columns of a paragraph or a run; only a run has formatting.

    hits: what each section's patterns found, if that has been put into columns of its own before.
    """

    def __init__(self, text: Column, style: Column, formatting: Column | None = None, hits: Column | None = None) -> None:
        self.text, self.style, self.formatting, self.hits = text, style, formatting, hits

    def hit(self, section: str, rules: Rules, low: Column | None = None) -> Column:
        """The first pattern of a section that is found; all of them for copyright notices."""
        if self.hits is not None:
            return self.hits[section]
        find = all_hits if section == "copyright_notices" else first_hit
        return find(self.text, rules.section(section).patterns, low)

    def solid(self) -> Column:
        return nonblank(self.text) if self.hits is None else self.hits["solid"]


def detection(order: int, kind: str, confidence: Column, reason: Column) -> Column:
    return F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("content_type"), confidence.cast("double").alias("confidence"), reason.alias("reason"))


def specifier_note(e: Element, rules: Rules) -> tuple[Column, Column]:
    """Sums a pattern (0.6) and formatting: italic (0.2), a listed colour (0.3), a listed style (0.8); at most 1."""
    hit = e.hit("specifier_notes", rules)
    parts = [(hit.isNotNull(), 0.6, F.concat(F.lit("Pattern match: "), hit))]
    if e.formatting is not None:
        colour = e.formatting["color"]
        parts.append((e.formatting["italic"], 0.2, F.lit("Italic text")))
        parts.append((F.upper(colour).isin([c.upper() for c in rules.colors]), 0.3, F.concat(F.lit("Color: "), colour)))
    kind = "Paragraph style: " if e.formatting is None else "Style: "
    parts.append((e.style.isin(list(rules.styles)), 0.8, F.concat(F.lit(kind), e.style)))
    total, reasons = F.lit(0.0), []
    for test, weight, reason in parts:
        test = F.coalesce(test, F.lit(False))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        reasons.append(F.when(test, reason))
    return F.when(e.solid() & (total >= THRESHOLD), F.least(total, F.lit(1.0))), F.concat_ws("; ", *reasons)


def copyright_notice(e: Element, rules: Rules) -> tuple[Column, Column]:
    """0.7 for each pattern and 0.2 for more than one; at most 1."""
    hits = e.hit("copyright_notices", rules)
    score = F.when(F.size(hits) >= 2, F.lit(1.0)).when(F.size(hits) == 1, F.lit(0.7))
    listed = F.transform(hits, lambda p: F.concat(F.lit("Pattern match: "), p))
    many = F.when(F.size(hits) >= 2, F.array(F.concat(F.lit("Multiple indicators: "), F.size(hits).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.when(e.solid(), score), F.array_join(F.concat(listed, many), "; ")


def hidden_text(e: Element, rules: Rules) -> tuple[Column, Column]:
    """Runs marked as hidden; blank ones too."""
    hidden = F.lit(False) if e.formatting is None else F.coalesce(e.formatting["hidden"], F.lit(False))
    return F.when(hidden, F.lit(1.0)), F.lit("Hidden text (vanish property)")


def first_pattern(section: str, score: float, label: str) -> Callable[[Element, Rules], tuple[Column, Column]]:
    def found(e: Element, rules: Rules) -> tuple[Column, Column]:
        hit = e.hit(section, rules)
        return F.when(hit.isNotNull() & e.solid(), F.lit(score)), F.concat(F.lit(label), hit)

    return found


DETECTORS = (
    ("specifier_note", "specifier_notes", specifier_note),
    ("copyright", "copyright_notices", copyright_notice),
    ("hidden_text", "hidden_text", hidden_text),
    ("specagent", "specagent_references", first_pattern("specagent_references", 1.0, "SpecAgent reference: ")),
    ("editorial_artifact", "editorial_artifacts", first_pattern("editorial_artifacts", 0.8, "Editorial artifact: ")),
)
PRESERVE = first_pattern("preserve_patterns", 1.0, "Preserved content: ")


def detections(e: Element, rules: Rules = DEFAULT, custom: Sequence[Custom] = (), whitelist: bool = True) -> Column:
    """All detections of an element, in the order of the detectors; a whitelisted element has that one alone."""
    found = [detection(i, kind, *detector(e, rules)) for i, (kind, section, detector) in enumerate(DETECTORS) if rules.section(section).enabled]
    found += [detection(len(DETECTORS) + i, kind, *build(e)) for i, (kind, build) in enumerate(custom)]
    none = F.array().cast(f"array<{DETECTION}>")
    some = F.filter(F.array(*found), lambda d: d["confidence"].isNotNull()).cast(f"array<{DETECTION}>") if found else none
    if not (whitelist and rules.section("preserve_patterns").enabled):
        return some
    kept = detection(-1, "preserve", *PRESERVE(e, rules))
    return F.when(kept["confidence"].isNotNull(), F.array(kept).cast(f"array<{DETECTION}>")).otherwise(some)


def preserved(found: Column) -> Column:
    return F.exists(found, lambda d: d["content_type"] == "preserve")


def removable(found: Column) -> Column:
    return ~preserved(found) & F.exists(found, lambda d: d["confidence"] >= THRESHOLD)


def paragraph_element(text: str = "txt", style: str = "pstyle") -> Element:
    return Element(F.col(text), F.col(style))


def run_element(text: str = "txt", style: str = "rstyle") -> Element:
    return Element(F.col(text), F.col(style), F.struct("italic", "color", "hidden"))


def with_detections(df: DataFrame, element: Element, rules: Rules = DEFAULT, name: str = "found", custom: Sequence[Custom] = ()) -> DataFrame:
    """Adds the detections. What each section's patterns found is worked out once first, so that no pattern is tried twice."""
    low = F.col("_low")
    hits = F.struct(nonblank(element.text).alias("solid"), *(element.hit(s, rules, low).alias(s) for s in SECTIONS if s != "hidden_text"))
    found = once(df.withColumn("_low", lowered(element.text)), "_hits", hits)
    ready = Element(element.text, element.style, element.formatting, F.col("_hits"))
    return found.withColumn(name, detections(ready, rules, custom)).drop("_low", "_hits")


def exploded(df: DataFrame, name: str = "found") -> DataFrame:
    """A row for each detection. Outer, as otherwise the optimizer tests the whole array a second time before."""
    return df.select("*", F.inline_outer(name)).drop(name).where(F.col("content_type").isNotNull())


def decide(paragraphs: DataFrame, runs: DataFrame, keys: Sequence[str], rules: Rules = DEFAULT) -> DataFrame:
    """What becomes of each paragraph, from its own detections and those of its runs.

    Runs are looked at only where the paragraph itself is neither whitelisted nor removed. A whitelisted paragraph
    or run keeps the paragraph; a paragraph whose text runs are all detected goes. What is detected in a run
    of a paragraph that stays is reported, not removed.
    """
    own = with_detections(paragraphs, paragraph_element(), rules, "own")
    spotted = with_detections(runs.where(nonblank(F.col("txt"))), run_element(), rules, "found")
    return decide_found(own, spotted, keys)


def settled(own: Column) -> Column:
    """Whether a paragraph's own detections alone decide."""
    return preserved(own) | removable(own)


def decide_found(paragraphs: DataFrame, runs: DataFrame, keys: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """The same from paragraphs with their own detections, and runs that aren't blank with theirs; with some columns of the paragraphs."""
    keys, own = list(keys), F.col("own")
    grouped = runs.groupBy(*keys).agg(
        F.count("*").alias("text_runs"),
        F.count_if(removable(F.col("found"))).alias("hit_runs"),
        F.sum(F.size("found")).alias("run_found"),
        F.bool_or(preserved(F.col("found"))).alias("run_kept"),
    )
    joined = paragraphs.join(grouped, keys, "left")
    looked = F.coalesce(~settled(own) & (F.col("text_runs") > 0), F.lit(False))
    by_runs = looked & ~F.col("run_kept") & (F.col("hit_runs") == F.col("text_runs"))
    return joined.select(
        *keys,
        *carried,
        F.size("own").cast("bigint").alias("own_detections"),
        F.when(looked, F.col("run_found")).otherwise(F.lit(0)).cast("bigint").alias("run_detections"),
        F.when(preserved(own), "whitelisted").when(removable(own), "paragraph").when(looked & F.col("run_kept"), "run whitelisted").when(by_runs, "all runs").otherwise("kept").alias("decision"),
        (removable(own) | by_runs).alias("removed"),
        settled(own).alias("settled"),
    )


def loose_runs(runs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The second look at runs that aren't direct children of their paragraph: blank ones too, whatever the paragraph."""
    return with_detections(runs.where(~F.col("parent_is_p")), run_element(), rules)
