"""Judge requests and recorded judge verdicts.

The call to a judge is outside: requests go out as a table, and verdicts come back as
``judgements(sample_id, turn_ix, constraint_id, kind, verdict_text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import judge_verdict

CONSTRAINT, HELPFULNESS = "constraint", "helpfulness"

# The two prompts a judge is asked with.
CONSTRAINT_PROMPT = """Your task is to verify if the given response satisfies the given constraint. 
You should also verify if the given response makes sense and is generally helpful. 

If the response does not satisfy the constraint, return no.
If the response satisfies the constraint, but is not helpful, return no.
Otherwise, return yes.
Wrap your verification (yes or no) in a XML tag:
<answer>yes or no</answer>

**Constraint**
{constraint}

**Response**
{response}
"""
HELPFULNESS_PROMPT = """Your task is to verify if the given response makes sense and is generally helpful. 
Unhelpful responses include but are not limited to severely incomplete sentences, keeping repeating the same content, or overly simplified responses.
Unless the constraints require the response to do so, above is considered as unhelpful.
You do not need to verify if the response satisfies the given constraints.

If the given response is unhelpful, return no. Otherwise, return yes.
Wrap your verification (yes or no) in a XML tag:
<answer>yes or no</answer>

**Constraint**
{constraint}

**Response**
{response}
"""


def judge_prompt(prompt: str, constraint: Column, response: Column) -> Column:
    """The prompt with both texts in place; text inside them is never substituted."""
    head, rest = prompt.split("{constraint}")
    middle, end = rest.split("{response}")
    return F.concat(F.lit(head), constraint, F.lit(middle), response, F.lit(end))


def selected(keys: list[str | Column], rate: float, seed: int = 0) -> Column:
    """True for a share ``rate`` of the keys; the same rows on every run."""
    digest = F.md5(F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed))))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return share < F.lit(float(rate))


def is_hard(kind: Column) -> Column:
    """Whether rules decide; a constraint of any other type, or of none, is the judge's."""
    return F.coalesce(kind == "hard", F.lit(False))


def judge_requests(scored: DataFrame, rate: float = 0.0, seed: int = 0) -> DataFrame:
    """One request per soft check, and per hard check drawn for the helpfulness question."""
    keys = ["sample_id", "turn_ix", "ver_ix"]
    hard = is_hard(F.col("verifier_type"))
    drawn = scored.filter(F.col("known") & (~hard | selected(keys, rate, seed)))
    texts = F.col("constraint"), F.col("response")
    return drawn.select(
        *keys,
        F.col("id").alias("constraint_id"),
        F.when(hard, HELPFULNESS).otherwise(CONSTRAINT).alias("kind"),
        F.when(hard, judge_prompt(HELPFULNESS_PROMPT, *texts))
        .otherwise(judge_prompt(CONSTRAINT_PROMPT, *texts))
        .alias("prompt"),
    )


def verdicts(judgements: DataFrame) -> DataFrame:
    """One verdict per sample, turn, constraint and kind; all recorded ones must pass."""
    return judgements.groupBy("sample_id", "turn_ix", "constraint_id", "kind").agg(
        F.bool_and(judge_verdict(F.col("verdict_text"))).alias("verdict")
    )


def with_verdicts(checks: DataFrame, judgements: DataFrame) -> DataFrame:
    """Add the verdict that concerns each check; without one the check passes."""
    keys = ["sample_id", "turn_ix", "id", "_kind"]
    known = verdicts(judgements).select(
        "sample_id",
        "turn_ix",
        F.col("constraint_id").alias("id"),
        F.col("kind").alias("_kind"),
        "verdict",
    )
    kind = F.when(is_hard(F.col("verifier_type")), HELPFULNESS).otherwise(CONSTRAINT)
    return (
        checks.withColumn("_kind", kind)
        .join(known, keys, "left")
        .withColumn("verdict", F.coalesce("verdict", F.lit(True)))
        .select(*checks.columns, "verdict")
    )
