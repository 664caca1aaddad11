"""Ordered rules over opinion texts and judge biographies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Tokens, contexts and disposition cues, in the order in which they are tried.
# (cue, value where the United States is plaintiff or unknown, value where it is defendant)
US_TOKEN = r"(?iU)\b(united states|u\.?\s*s\.?a?\.?|u\.?\s*s\.?)\b"
CUES = [
    (r"\b(grant|granted|grants|allow|allowed|allows)\b.*\bmotion to suppress\b", 0, 1),
    (r"\b(deny|denied|denies)\b.*\bmotion to suppress\b", 1, 0),
    (r"\bdemurrer (overruled|denied)\b", 1, 0),
    (r"\bdemurrer (sustained|allowed|granted)\b", 0, 1),
    (r"\b(motion to (dismiss|quash).*(indictment|count)|motion in arrest of judgment)\b.*\b(denied|overruled)\b", 1, 0),
    (r"\b(motion to (dismiss|quash).*(indictment|count)|motion in arrest of judgment)\b.*\b(granted|allowed|sustained)\b", 0, 1),
    (r"\b(government|united states)\b.*\b(has not|hasn't|failed? to|did not|does not)\b.*\b(prove|establish|meet|carry)\b", 0, 1),
    (r"\b(beyond a reasonable doubt)\b.*\b(not (proven|met)|insufficient)\b", 0, 1),
    (r"\bmandatory minimum\b.*\b(not|no longer)\b.*\b(apply|applies|trigger|triggered)\b", 0, 1),
    (r"judgment for the united states", 1, 1),
    (r"judgment for the defendant", 0, 0),
]
SEPARATORS = [" v. ", " v ", "vs.", "vs "]
SCHOOLS = "harvard|yale|columbia|michigan|stanford"
DEGREES = r"j\.?d|ll\.?b|llm|s\.?j\.?d"
CLERKED = r"law clerk.*(supreme court|u\.s\. supreme court|court of appeals|circuit)"
PROFESSOR = r"(?U)\b(assistant|associate)?\s*professor\b"
ADJUNCT = r"(?U)\b(adjunct|visiting|lecturer)\b"


def us_support(name: Column, text: Column) -> Column:
    """1 if the ruling favours the United States, 0 if not, null if no cue decides."""
    caption, t = F.lower(F.coalesce(name, F.lit(""))), F.lower(text)
    right = F.lit("")
    for sep in reversed(SEPARATORS):
        has = caption.contains(sep)
        right = F.when(has, caption.substr(F.instr(caption, F.lit(sep)) + len(sep), F.length(caption))).otherwise(right)
    defends = right.rlike(US_TOKEN)

    def ruled(defendant: Column) -> Column:
        out = F.lit(None).cast("int")
        for cue, plaintiff, other in reversed(CUES):
            value = F.lit(plaintiff) if plaintiff == other else F.when(defendant, F.lit(other)).otherwise(F.lit(plaintiff))
            out = F.when(F.rlike(t, F.lit("(?U)" + cue)), value).otherwise(out)
        return out

    # the one-element transform reads the caption once for all cues
    out = F.get(F.transform(F.array(defends), ruled), F.lit(0))
    return F.when(strip(t) != "", out)


def prestige(schools: list[Column], degrees: list[Column], career: Column, weights: tuple[int, int, int] = (1, 1, 1)) -> Column:
    """Weighted sum of law school, clerkship and professorship indicators."""
    joined = lambda cs: F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in cs)))
    s, d, pc = joined(schools), joined(degrees), F.lower(F.coalesce(career, F.lit("")))
    law = s.rlike(f"({SCHOOLS}).*law") | (d.rlike(DEGREES) & s.rlike(SCHOOLS))
    teaches = pc.rlike(PROFESSOR) & ~pc.rlike(ADJUNCT)
    return weights[0] * law.cast("int") + weights[1] * pc.rlike(CLERKED).cast("int") + weights[2] * teaches.cast("int")
