"""Columns from columns: ids, flags, literals and labels of single criteria."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Text without white space of any kind at its ends; most has none, which its first and last letters tell."""
    text = col(x).cast("string")
    plain = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(P.SPACE)))


def blank_to_null(x: Column | str) -> Column:
    text = strip(x)
    return F.when(text != "", text)


# --- ids and provenance ---------------------------------------------------------------------------------------


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix`` and 16 hex digits of the hash of the stripped parts; null, empty and the number 0 count as empty."""
    zero = lambda p: (F.typeof(col(p)) != "string") & (col(p).cast("string").try_cast("double") == 0)
    texts = [F.when(zero(p), "").otherwise(F.coalesce(strip(p), F.lit(""))) for p in parts]
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\x1f", *texts), 256), 1, 16))


def nct_id(x: Column | str) -> Column:
    """A registry id in upper case, or null if it is none."""
    text = F.upper(strip(x))
    return F.when(text.rlike(r"^NCT[0-9]{8}$"), text)


def registry_version(last_update: Column | str, first_post: Column | str) -> Column:
    return F.concat(F.lit("ctgov-"), F.coalesce(blank_to_null(last_update), blank_to_null(first_post), F.lit("unknown-date")))


def protocol_hash(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(text), 256))


def protocol_label(label: str, text: Column | str) -> Column:
    return F.concat(F.lit(f"{label}-"), F.substring(F.sha2(col(text), 256), 1, 12))


def text_version(text: Column | str) -> Column:
    return F.concat(F.lit("sha256-"), F.substring(F.sha2(col(text), 256), 1, 16))


# --- cells ----------------------------------------------------------------------------------------------------


def boolean_cell(x: Column | str) -> Column:
    """A sheet's yes/no cell; null for empty cells and for what is neither (see ``bad_boolean_cell``)."""
    text = F.lower(strip(x))
    return F.when(text.isin("true", "yes", "1"), True).when(text.isin("false", "no", "0"), False)


def bad_boolean_cell(x: Column | str) -> Column:
    return ~missing(x) & boolean_cell(x).isNull()


def optional_number(x: Column | str) -> Column:
    return blank_to_null(x).try_cast("double")


def confidence(x: Column | str) -> Column:
    """Clamped to 0..1; 0.5 if missing or no number."""
    found = col(x).cast("string").try_cast("double")
    return F.when(found.isNotNull() & ~F.isnan(found), F.greatest(F.lit(0.0), F.least(F.lit(1.0), found))).otherwise(0.5)


# --- language -------------------------------------------------------------------------------------------------


def operators(text: Column | str) -> Column:
    r"""One spelling for comparison signs: ``\>/=`` and ``≥`` become ``>=``."""
    plain = F.regexp_replace(F.regexp_replace(col(text), r"\\?([<>])\s*/\s*=", "$1="), r"\\(?=[<>])", "")
    return F.replace(F.replace(plain, F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<="))


def grade_last(text: Column | str) -> Column:
    return F.regexp_replace(col(text), P.jvm(r"(>=|<=|>|<)\s*grade\s*(\d+(?:\.\d+)?)"), "$1 $2 grade")


def says(text: Column | str, pattern: str) -> Column:
    return F.coalesce(col(text), F.lit("")).rlike(P.jvm(pattern))


def negated(text: Column | str) -> Column:
    return says(text, P.NEGATION)


def temporal(text: Column | str) -> Column:
    """All temporal phrases, pattern by pattern, each once; null if there are none."""
    found = [F.regexp_extract_all(col(text), F.lit(P.jvm(f"({p})")), F.lit(1)) for p in P.TEMPORAL]
    joined = F.array_join(F.array_distinct(F.transform(F.concat(*found), strip)), "; ")
    return F.when(joined != "", joined)


def repetition(text: Column | str) -> Column:
    found = strip(F.regexp_extract(col(text), P.jvm(f"({P.REPETITION})"), 1))
    return F.when(found != "", found)


def number(text: Column | str) -> Column:
    """A number written in digits, with or without thousands commas, or as a word up to ten."""
    words = F.create_map(*[F.lit(v) for pair in P.NUMBER_WORDS.items() for v in (pair[0], float(pair[1]))])
    plain = F.lower(strip(text))
    return F.coalesce(words[plain], F.replace(plain, F.lit(","), F.lit("")).try_cast("double"))


def comparator_symbol(phrase: Column | str) -> Column:
    plain = strip(F.regexp_replace(F.lower(col(phrase)), r"(?U)\s+", " "))
    return F.create_map(*[F.lit(x) for pair in P.WRITTEN_COMPARATORS.items() for x in pair])[plain]


def number_text(x: Column | str) -> Column:
    """A double as text, without a fraction if it is whole."""
    return F.when(col(x) == F.floor(col(x)), F.floor(col(x)).cast("long").cast("string")).otherwise(col(x).cast("string"))


def interval_notation(lower, lower_inclusive, upper, upper_inclusive) -> Column:
    left = F.when(F.coalesce(col(lower_inclusive), F.lit(False)), "[").otherwise("(")
    right = F.when(F.coalesce(col(upper_inclusive), F.lit(False)), "]").otherwise(")")
    text = F.concat(left, F.coalesce(number_text(lower), F.lit("-inf")), F.lit(", "), F.coalesce(number_text(upper), F.lit("+inf")), right)
    return F.when(col(lower).isNotNull() | col(upper).isNotNull(), text)


def common_time_bounds(lower, lower_unit, upper, upper_unit) -> Column:
    """struct(lower, upper, unit): months and years on the scale of the lower bound."""

    def clean(unit) -> Column:
        text = F.lower(strip(unit))
        known = reduce(lambda c, k: c.when(text.startswith(k), f"{k}s"), ("month", "week", "day"), F.when(text.startswith("year"), "years"))
        return F.when(text != "", known.otherwise(strip(unit)))

    low, high = clean(lower_unit), clean(upper_unit)
    scaled = F.when((low == "months") & (high == "years"), col(upper) * 12).when((low == "years") & (high == "months"), col(upper) / 12).otherwise(col(upper))
    return F.struct(col(lower).alias("lower"), scaled.alias("upper"), F.coalesce(low, high).alias("unit"))


def tidy_unit(unit: Column | str) -> Column:
    text = F.regexp_replace(strip(unit), r"(?U)\s+", " ")
    return F.when(text.rlike(P.jvm(r"upper\s+limit\s+of\s+normal|uln")), "x ULN").when(text != "", text)


def relations(comparator, negated_, temporal_, repetition_, qualifier, logic) -> Column:
    """Labels of what a criterion states, in fixed order."""
    there = lambda c, label: F.when(F.coalesce(col(c).cast("string"), F.lit("")) != "", label)
    return F.array_compact(
        F.array(
            there(comparator, "HAS_VALUE"),
            F.when(col(negated_), "HAS_NEGATION"),
            there(temporal_, "HAS_TEMPORAL"),
            there(repetition_, "HAS_MULTIPLIER"),
            there(qualifier, "HAS_QUALIFIER"),
            F.when(col(logic).isin("and", "or"), F.upper(col(logic))),
        )
    )


def criterion_relations(prefix: str = "") -> Column:
    """``relations`` of a criterion's own columns; a bound counts as a value."""
    has = F.coalesce(col("comparator"), F.when(col("lower_bound").isNotNull() | col("upper_bound").isNotNull(), "interval"))
    return relations(has, "negated", "temporal", "repetition", "qualifier", "logical_operator")


def infer_domain(entity, source, compared, aliases: dict[str, str]) -> Column:
    """A clinical domain by the longest alias that entity and source mention, else by cue words."""
    text = F.lower(F.concat_ws(" ", F.coalesce(col(entity), F.lit("")), F.coalesce(col(source), F.lit(""))))
    known = [(a, d) for a, d in sorted(aliases.items(), key=lambda x: -len(x[0])) if d in P.DOMAINS]
    named = [(text.rlike(P.jvm(rf"(?<!\w)\Q{a}\E(?!\w)")), d) for a, d in known]
    cues = []
    for pattern, domain in P.DOMAIN_CUES:
        seen = text.rlike(P.jvm(pattern))
        cues.append((seen | F.coalesce(col(compared), F.lit(False)) if domain == "measurement" else seen, domain))
    chain = lambda rules: reduce(lambda c, rule: c.when(*rule), rules[1:], F.when(*rules[0]))
    by_cue = chain(cues).otherwise("observation")
    if not named:
        return by_cue
    # most texts have no alias, which one pattern tells
    any_alias = text.rlike(P.jvm(r"(?<!\w)(?:" + "|".join(rf"\Q{a}\E" for a, _ in known) + r")(?!\w)"))
    return F.when(any_alias, chain(named)).otherwise(by_cue)


def missing(x: Column | str) -> Column:
    return F.coalesce(strip(x), F.lit("")) == ""


_JSON_FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
_JSON_BETWEEN = r"(?s)^(?:json)?\s*(\{.*\})\s*\z"


def model_json(text: Column | str) -> Column:
    """The JSON object in a model's answer: fenced, else from the first brace to the last."""
    text = col(text)
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    braced = F.when((first > 0) & (first < last) & text.contains("}"), F.substring(text, first, last - first + 1))
    once = lambda x, of: F.get(F.transform(F.array(x), of), F.lit(0))
    # what stands between the first two fences is most often the object, of which only the ends are looked at
    searched = once(F.regexp_extract(text, _JSON_FENCE, 1), lambda x: F.when(x != "", x))
    between = once(F.split(text, "```", 3), lambda x: F.when(F.size(x) == 3, F.regexp_extract(x[1], _JSON_BETWEEN, 1)))
    fenced = F.when(text.contains("```"), once(between, lambda x: F.when(x != "", x).otherwise(searched)))
    return F.coalesce(fenced, braced)
