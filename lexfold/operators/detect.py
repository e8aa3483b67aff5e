"""The six detectors as column expressions over a sentence, and their registry.

A detector is a ``Rule``: category, label, base severity and a function from the
sentence's match copy (and its lead-in's) to a decision.  A decision is the match's
severity: null for no match, the empty string for a match that inherits the
base severity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfold.functions import vocabulary as v
from lexfold.functions.text import any_of, let, match_copy, matches, prefixes
from lexfold.operators.segment import spans

INHERITED = ""


@dataclass(frozen=True)
class Rule:
    """``decide(copy, lead)`` gives a severity, ``INHERITED`` or null.

    ``stems``: lower-case beginnings of words, one of which any hit has in its sentence or lead-in; with none, every sentence is judged.
    """

    id: str
    category: str
    label: str
    severity: str
    decide: Callable[[Column, Column], Column]
    stems: tuple[str, ...]
    #: Order of a text's matches of this rule; they come by sentence.
    arrange: Callable[[Column], Column] = lambda found: found
    #: A further pattern for sentences to be judged, beside the stems.
    also: str = ""


def _before(c: Column, pattern: str) -> Column:
    return F.split(c, f"(?i){pattern}", 2)[0]


def _after(c: Column, pattern: str) -> Column:
    return F.coalesce(F.try_element_at(F.split(c, f"(?i){pattern}", 2), F.lit(2)), F.lit(""))


def sensitive(s: Column) -> Column:
    return matches(s, v.SENSITIVE) | matches(s, v.SENSITIVE_CASED, ignore_case=False)


def collects(s: Column, lead: Column) -> Column:
    """Sensitive items need no verb; ordinary ones need a collection context; a denied act is neither."""
    return F.when(matches(s, v.COLLECTION_DENIED), None).when(sensitive(s), "warning").when(matches(s, v.ORDINARY), "info")


def unquoted(s: Column) -> Column:
    """Quotes around a single word do not hide it."""
    return F.regexp_replace(s, v.QUOTED_WORD, "$1")


def asserts_sale(s: Column) -> Column:
    """Whether a sentence says that data is sold; what follows a contrast counts by itself where the part before it denies."""
    strong, positive = matches(s, v.SALE_STRONG), matches(s, v.SALE_POSITIVE)
    pivots = matches(s, v.SALE_CONTRAST)
    head, tail = _before(s, v.SALE_CONTRAST), _after(s, v.SALE_CONTRAST)
    qualified = matches(head, v.SALE_QUALIFIED_DENIAL)
    admits = matches(tail, [*v.SALE_POSITIVE, *v.SALE_STRONG]) | (qualified & matches(tail, v.SALE_DISCLOSURE))
    return ((strong & (pivots | ~matches(s, v.SALE_STRONG_DENIED)))
            | (positive & ~matches(s, v.SALE_DENIED))
            | (pivots & (matches(head, v.SALE_DENIED) | qualified) & ~matches(tail, v.SALE_TAIL_DENIED) & admits))


def sells(s: Column, lead: Column) -> Column:
    bare = unquoted(s)
    return F.when(~matches(bare, v.SALE_RIGHTS) & asserts_sale(bare), INHERITED)


def shares_at_all(s: Column) -> Column:
    start, name = v.SHARED_WITH_CASED
    return matches(s, v.SHARING_POSITIVE) | matches(s, rf"{start}(?!(?:{v.NOT_RECIPIENTS})\b){name}", ignore_case=False)


def discloses(s: Column) -> Column:
    """Whether a sentence says that data is shared; a denial counts up to the exception or contrast after it."""
    denied = any_of(v.SHARING_DENIED)
    # the earliest denial ends where the first split by each pattern that matches earliest does
    heads = [F.when(matches(s, p), F.length(_before(s, p))) for p in v.SHARING_DENIED]
    earliest = F.least(*heads)
    tail = F.lit("")
    for p, h in reversed(list(zip(v.SHARING_DENIED, heads))):
        tail = F.when(h == earliest, _after(s, p)).otherwise(tail)
    return (F.when(~s.rlike(denied), shares_at_all(s))
            .when(matches(tail, v.SHARING_EXCEPTION), matches(s, v.SHARING_DENIED_DATA) | shares_at_all(s))
            .when(matches(tail, v.SHARING_CONTRAST), shares_at_all(_after(tail, v.SHARING_CONTRAST)))
            .otherwise(F.lit(False)))


def shares(s: Column, lead: Column) -> Column:
    """An item of a list is read after its lead-in, unless that is a disclosure by itself."""
    alone = discloses(s)
    carried = discloses(F.concat_ws(" ", lead, s))
    return F.when(F.when(lead.isNotNull() & ~F.coalesce(discloses(lead), F.lit(False)), carried).otherwise(alone), INHERITED)


def retains(s: Column, lead: Column) -> Column:
    """Vague periods concern; definite ones inform; both need a verb of keeping."""
    return F.when(~matches(s, v.RETENTION_CONTEXT), None).when(matches(s, v.RETENTION_VAGUE), "caution").when(matches(s, v.RETENTION_SPECIFIC), "info")


def any_pattern(positive: tuple[str, ...], veto: tuple[str, ...] = ()) -> Callable[[Column, Column], Column]:
    """A rule that is a list of patterns, with vetoes if any."""
    return lambda s, lead: F.when(matches(s, positive) & (~matches(s, veto) if veto else F.lit(True)), INHERITED)


def warnings_first(found: Column) -> Column:
    return F.concat(F.filter(found, lambda m: m["severity"] == "warning"), F.filter(found, lambda m: ~m["severity"].eqNullSafe("warning")))


def _rules() -> tuple[Rule, ...]:
    decide = {
        "data_collection": (collects, ("social", "driver", "passport", "financial", "bank", "card", "medical", "health", "classification", "race", "ethnicity", "origin", "orientation", "religious", "biometric", "sensory",
                                       "fingerprint", "faceprint", "voiceprint", "precise", "geolocation", "gps", "bluetooth", "wi-fi", "wifi", "cell", "session", "keystroke", "mouse", "screen", "inference", "profil", "aprofile",
                                       "ssn", "collect", "categories", "identifiers", "information"), warnings_first),
        # words may join where quotes leave them
        "data_sale": (sells, ("sell", "sold", "sale", "consideration", "exchange"), lambda found: found, rf"[a-z]{v.QUOTED_WORD}|{v.QUOTED_WORD}[a-z]"),
        "third_party_sharing": (shares, ("shar", "disclos", "provid", "releas", "produc", "over", "comply", "respon", "pursuant", "transfer", "receive", "access", "collect", "obtain", "display", "advertising", "internet", "analytics",
                                         "social", "government", "brokers", "operating", "sell", "event", "outside", "abroad", "countries", "border", "internationally")),
        "retention": (retains, ("retain", "retention", "keep", "kept", "stor", "delet", "preserve", "maintain", "hold", "held")),
        "arbitration": (any_pattern(v.ARBITRATION), ("arbitrat", "waiv")),
        "class_action_waiver": (any_pattern(v.CLASS_WAIVER), ("class", "waiv", "plaintiff", "representative", "collective", "individual")),
    }
    return tuple(Rule(c, c, label, severity, *decide[c]) for c, label, severity in v.CATEGORIES)


#: The registry: a new detector is one entry here.
RULES = _rules()

MATCH = "struct<category:string,detector_id:string,ord:int,sentence:string,index:int,severity:string>"


def stemmed(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text, or its match copy, has what a hit of any of the rules has."""
    sieves = [rf"(?<![a-z0-9_])(?:{prefixes([stem for r in rules for stem in r.stems])})", *(r.also for r in rules if r.also)]
    return F.coalesce(text.rlike(f"(?i){'|'.join(sieves)}"), F.lit(False))


def decisions(sentence: Column, lead_in: Column, rules: tuple[Rule, ...] = RULES, prefilter: bool = True) -> Column:
    """array<struct<ord, decision>> of the rules that a sentence matches."""

    def of(s: Column) -> Column:
        def with_lead(lead: Column) -> Column:
            # stems are sought in the lead-in too, which a rule may read
            found = [F.when(stemmed(s, (r,)) | stemmed(lead, (r,)), r.decide(s, lead)) if prefilter and r.stems else r.decide(s, lead) for r in rules]
            each = [F.struct(F.lit(k).alias("ord"), d.cast("string").alias("decision")) for k, d in enumerate(found)]
            return F.filter(F.array(*each), lambda x: x["decision"].isNotNull())

        return let(match_copy(lead_in), with_lead)

    return let(match_copy(sentence), of)


def matches_in(spans: Column, rules: tuple[Rule, ...] = RULES, prefilter: bool = True) -> Column:
    """array<MATCH> of a text's spans, by sentence, then by rule; severity is null where it is inherited."""
    name = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k + 1)
    ids, categories = [r.id for r in rules], [r.category for r in rules]
    if prefilter and all(r.stems for r in rules):
        # one pattern for all rules spares most sentences everything else
        spans = F.filter(spans, lambda x: stemmed(x["sentence"], rules) | stemmed(x["lead_in"], rules))
    return F.flatten(F.transform(spans, lambda x: F.transform(decisions(x["sentence"], x["lead_in"], rules, prefilter), lambda d: F.struct(
        name(categories, d["ord"]).alias("category"), name(ids, d["ord"]).alias("detector_id"), d["ord"].alias("ord"),
        x["sentence"].alias("sentence"), x["index"].alias("index"), F.nullif(d["decision"], F.lit(INHERITED)).alias("severity")))))


def analyze(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, prefilter: bool = True) -> DataFrame:
    """(*keep, spans, matches): each text segmented once and judged by every rule, inside its row."""
    return df.select(*keep, spans(F.col(text)).alias("spans")).withColumn("matches", matches_in(F.col("spans"), rules, prefilter))


def flat_matches(analyzed: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, category, detector_id, ord, sentence, index, severity): one row for each match."""
    return analyzed.select(*keep, F.inline_outer("matches")).where(F.col("category").isNotNull())


def results(analyzed: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(*keep, ord, category, label, base_severity, found, matches): a row for each text and category, in registry order, found or not.

    Matches of rules that share a category follow each other in the order of the rules.
    """
    seen: dict[str, Rule] = {}
    for r in rules:
        seen.setdefault(r.category, r)

    def of_rule(k: int) -> Column:
        return F.filter("matches", lambda m: m["ord"] == k)

    def of(r: Rule) -> Column:
        parts = [q.arrange(of_rule(k)) for k, q in enumerate(rules) if q.category == r.category]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    rows = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(r.category).alias("category"), F.lit(r.label).alias("label"), F.lit(r.severity).alias("base_severity"), of(r).alias("matches")) for k, r in enumerate(seen.values())))
    return analyzed.select(*keep, F.inline(rows)).select(*keep, "ord", "category", "label", "base_severity", (F.size("matches") > 0).alias("found"), "matches")
