"""Vocabularies and the patterns of eligibility language.

All of these must stay as they are for results to agree with earlier extractions.
"""

from __future__ import annotations

DOMAINS = ("observation", "condition", "person", "device", "drug", "visit", "procedure", "measurement")
LOGIC = ("standalone", "and", "or")
COMPARATORS = (">", ">=", "<", "<=", "=")
REVIEWED = ("accepted", "corrected")
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
WRITTEN_COMPARATORS = {
    "no more than": "<=", "at most": "<=", "less than or equal to": "<=", "or fewer": "<=", "or less": "<=",
    "greater than or equal to": ">=", "at least": ">=", "minimum of": ">=", "or more": ">=", "or greater": ">=",
    "less than": "<", "below": "<", "more than": ">", "greater than": ">", "above": ">",
}

# White space, whatever its kind.
SPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Units and numbers, as parts of other patterns.
_NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
_PLAIN = r"\d+(?:\.\d+)?"
_COMPARED_UNIT = (
    r"msec|ms|sec(?:ond)?s?|mmHg|mg/dL|mmol/L|µmol/L|umol/L|kg/m2|kg/m²|IU/L|U/L|cells?/[uµμ]L|platelets?/[uµμ]L|pg/mL|ng/mL|g/dL|"
    r"mL/min(?:/1\.73\s*m2)?|years?|months?|weeks?|days?|%|grade|x?\s*(?:ULN|upper\s+limit\s+of\s+normal(?:\s*\(ULN\))?)"
)
_AGED_UNIT = r"years?(?:\s+old|\s+of\s+age)?|months?|weeks?|days?|kg/m2|kg/m²|mmHg|mg/dL|mmol/L|%"
_UPPER_UNIT = r"years?|months?|weeks?|days?|kg/m2|kg/m²|mmHg|mg/dL|mmol/L|%"
_WORD_NUMBER = "zero|one|two|three|four|five|six|seven|eight|nine|ten"
_TIME = r"(?:hours?|days?|weeks?|months?|years?)"

# Comparisons and ranges; these are for Python, case-insensitive.
COMPARISON = rf"(?P<op>>=|<=|>|<|=|≥|≤)\s*(?P<value>{_NUMBER}(?:\s*/\s*{_NUMBER})?)(?P<unit>\s*(?:{_COMPARED_UNIT}))?"
RANGE_TO = rf"(?:(?:between|from|aged?|ages?)\s*)?(?P<lower>{_PLAIN})\s*(?:to|through|[-–—])\s*(?P<upper>{_PLAIN})\s*(?P<unit>{_AGED_UNIT})?"
RANGE_AND = rf"between\s+(?P<lower>{_PLAIN})\s+and\s+(?P<upper>{_PLAIN})\s*(?P<unit>{_AGED_UNIT})?"
RANGE_OPS = rf"(?P<lower_op>>=|>)\s*(?P<lower>{_PLAIN})\s*(?P<lower_unit>{_AGED_UNIT})?\s*(?:and|,)?\s*(?P<upper_op><=|<)\s*(?P<upper>{_PLAIN})\s*(?P<unit>{_UPPER_UNIT})?"
WRITTEN = (
    r"(?P<phrase>no\s+more\s+than|at\s+most|less\s+than\s+or\s+equal\s+to|greater\s+than\s+or\s+equal\s+to|at\s+least|minimum\s+of|more\s+than|greater\s+than|less\s+than|above|below)\s+"
    rf"(?P<value>\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|{_PLAIN}|{_WORD_NUMBER})\s*(?P<unit>%|mg|g|ml|mL|mmHg|m/s|/mcl|mcl|weeks?|months?|years?|days?|cycles?|drugs?)?"
)
WRITTEN_AFTER = rf"(?P<value>{_PLAIN}|{_WORD_NUMBER})\s+(?P<phrase>or\s+more|or\s+greater|or\s+fewer|or\s+less)\s+(?P<entity>[A-Za-z][A-Za-z0-9 /-]{{1,60}}?)(?=\s+(?:at|with|who|that|during|for|$)|[.,;()])"

# How a compared or ranged measurement is named; for Python, case-insensitive unless said otherwise.
NAME_TAIL = r"\s+(?:score|status|level|count)$"
LABEL_BREAK = r"(?:[(:,;]|\b(?:and|or)\b)\s*"
LABELS = (
    r"(?:(?:systolic|diastolic|mean)\s+)?(?:bp|msdbp|mssbp|egfr|bmi|alt|ast)\s*$",
    r"(?:[A-Za-z][A-Za-z0-9-]*\s+){0,2}(?:pressure|count|level|fraction|score|rate|clearance|saturation|platelets?|neutrophils?|troponin|bilirubin)\s*$",
    r"(?-i:^[A-Z][A-Z0-9-]{1,12}$)",
)
LABEL_WORDS = 5
AGED = r"\b(?:aged?|ages?)\b"
AGED_START = r"^(?:aged?|ages?)\b"
AGE_OF_YEARS = r"\b(?:age|aged|years?\s+(?:of\s+age|old))\b"
UPPER_LIMIT = r"upper\s+limit\s+of\s+normal|uln"
IN_WINDOW = r"\bwithin\s*$"
LEAD_IN = r"^(?:must\s+have|patients?\s+with|participants?\s+with|history\s+of|no\s+history\s+of|without|exclude(?:d)?\s+)"

# How a comparison that is written in words is named; for Python, case-insensitive.
DURATION_NAMES = (
    (("life expectancy",), "life expectancy"),
    (("remission",), "remission duration"),
    (("disease-free",), "disease-free duration"),
    (("most recent", "stro"), "time since most recent stroke"),
    (("implanted",), "time since implantation"),
    (("completed",), "time since treatment completion"),
    (("stable",), "{subject} stability duration"),
    (("diagnosis",), "time since diagnosis"),
    (("birth control",), "birth control duration"),
    ((), "duration"),
)
STABLE = r"\bstable\b"
STABLE_LINK = r"\b(?:must|should)\s+be\s*$|\b(?:is|are|be)\s*$"
STABLE_LEADS = (r"^(?:(?:the|above)\s+)+", r"^(?:dosing\s+)?of\s+(?:the\s+)?(?:above\s+)?")
CYCLES_OF = r"^of\s+([^.]*)"
CYCLES_TAIL = r"\b(?:required|allowed)\s*$"
COUNTED = r"^(?!(?:prior|after|before|since|ago|per)\b)(?:of\s+(?:the\s+)?+)?+([A-Za-z][A-Za-z0-9 /-]{1,50}?)(?=\s+(?:with|who|that|at|during|for|of)|[,.;:()]|$)"
COUNTED_TAIL = r"\s+applies$"
FAILURE_RATE = r"\bfailure rate\b"
PERCENT_OF = r"^(?!(?:of|in|at|when|that|which|per)\b)([A-Za-z][A-Za-z -]{1,35}?)(?=\s+(?:of|in|at|when|that|which)|[,.;()]|$)"
CLAUSE_TO = r"\bto\s*$"
CLAUSE_LEAD = r".*\b(?:with|either|and|or|including|demonstrating|to)\s+"
CLAUSE_LINK = r"\b(?:must\s+be|should\s+be|is|are|for)\s*$"
CLAUSE_WORDS = 6
UNNAMED = "explicit comparison"

# Language of a statement; these are for Spark and Python alike.
NEGATION = r"(?:^|[;:,.]\s*)(?:no(?!\s+more\s+than)|not|without|negative\s+for|absence\s+of|free\s+of|never)\b|\bno\s+(?:known\s+)?history\s+of\b"
REPETITION = r"\b(?:on\s+)?(?:one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:occasions?|times?|measurements?|visits?)\b"
TEMPORAL = (
    r"\bhistory\s+of\b",
    r"^previous\b",
    r"\b(?:a\s+)?previous\s+diagnosis\s+of\b",
    r"\b(?:before|prior to)\s+(?:treatment initiation|entering (?:the )?study|registration(?: in (?:the )?trial)?|enrollment|(?:the )?screening(?: visit)?|randomization)\b",
    rf"\bwithin\s+(?:the\s+)?(?:past|previous|last|recent)?\s*\d+(?:\s*[-–—]\s*\d+)?\s+{_TIME}(?:\s+(?:before|prior to|after)\s+[^,.;]+)?",
    r"\bduring\s+[^,.;]+",
    r"\bduring/following\s+[^,.;]+",
    rf"(?:<|<=|>|>=)\s*\d+\s+{_TIME}\s+(?:before|after)\s+[^,.;]+",
    rf"\b(?:for|during)\s+(?:at least|more than|less than|>|<|≥|≤)?\s*\d+\s+{_TIME}\b",
    rf"\b(?:in|over)\s+(?:the\s+)?(?:past|previous|last)?\s*\d+\s+{_TIME}\b",
    rf"\b(?:at least|more than|less than)\s+\d+\s+{_TIME}\b",
)
HEADING = (
    r"^(?:\d+(?:\.\d+)*\s+)?\*{0,2}(?:(?:general|key|main|additional|specific)\s+)?(inclusion|exclusion)\s+criteria"
    r"(?:\s+(?:for|trial|registry|part|cohort|participants?|patients?|subjects?|stage)\b.*?)?\s*:?\*{0,2}$"
)
LABELLED_FIELD = r"\b(?:age|performance\s+status|life\s+expectancy|hematopoietic|hepatic|renal|cardiovascular|pulmonary|neurologic|other)\s*:"
DOMAIN_CUES = (
    (r"\b(age|sex|gender|male|female|pregnan|body mass index|bmi)\b", "person"),
    (r"\b(drug|medication|prednisone|estrogen|therapy|dose|inhibitor)\b", "drug"),
    (r"\b(surgery|procedure|resection|transplant|dialysis|imaging|biopsy)\b", "procedure"),
    (r"\b(device|implant|pacemaker|prosthe)\b", "device"),
    (r"\b(visit|screening|follow-up|hospitali[sz]ation)\b", "visit"),
    (r"\b(level|count|pressure|score|index|test|laboratory|hba1c)\b", "measurement"),
    (r"\b(history|diagnos|disease|cancer|syndrome|failure|impairment|migraine|thromb|embol)\b", "condition"),
)

# What validation looks for.
COMPARISON_LANGUAGE = r"(?:>=|<=|>|<|=|≥|≤|\b(?:greater|less|more|younger|older|above|below|between)\b)"
NEGATION_LANGUAGE = r"\b(?:no(?!\s+more\s+than)|not|without|absence of|negative for|free of|never)\b"
NOT_DUE_TO = r"\bnot\s+due\s+to\b"
TEMPORAL_LANGUAGE = r"\b(?:within|prior to|before|after|during|for at least|past|previous|last|history of)\b"
REPETITION_LANGUAGE = r"\b(?:once|twice|\d+|one|two|three|four|five)\s+(?:occasions?|times?|measurements?|visits?)\b"
COMPARISON_WITH_UNIT = (
    r"(?:>=|<=|>|<|=|≥|≤)\s*\d+(?:\.\d+)?(?:\s*/\s*\d+(?:\.\d+)?)?\s*(?:kg/m2|kg/m²|iu/l|u/l|ml/min(?:/1\.73\s*m2)?|cells?/(?:ul|mm\^?3)|"
    r"pg/ml|ng/ml|mg/dl|mmol/l|umol/l|µmol/l|g/dl|mmhg|seconds?|sec|msec|ms|%|x\s*uln)\b"
)
COMPOUND_LANGUAGE = r"\b(?:and|or|except|unless)\b|;"


def jvm(pattern: str) -> str:
    """A pattern for Spark's regular expressions, with Python's idea of case, words and spaces."""
    return "(?iU)" + pattern
