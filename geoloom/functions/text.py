"""Text expressions: ids, links, model names and reply clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spec_id(**fields: Column) -> Column:
    """S1. Short id of a request: hash of its fields as JSON with sorted keys."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, 16)


def sign_href(href: Column, token: Column, provider: Column) -> Column:
    """S7. Append the token as a query part; links of the secondary provider stay as they are."""
    glue = F.when(F.instr(href, "?") > 0, "&").otherwise("?")
    return F.when(provider == "secondary", href).otherwise(F.concat(href, glue, token))


def quote_keep_comma(text: Column) -> Column:
    """Percent-encoding that leaves commas and writes a blank as %20."""
    enc = F.url_encode(text)
    return F.replace(F.replace(enc, F.lit("+"), F.lit("%20")), F.lit("%2C"), F.lit(","))


def model_parts(name: Column) -> Column:
    """S9. ``vN-FT-Task-Base`` is a fine-tuned head, ``vN-Base`` an encoder; else unknown."""
    last = F.element_at(F.split(name, "/"), -1)
    head = r"-(v[0-9]+)-FT-([A-Za-z0-9]+)-(Base|Nano|Tiny|Large)$"
    enc = r"(?i)-(v[0-9]+)-(nano|tiny|base|large)$"
    is_head, is_enc = last.rlike(head), last.rlike(enc)
    size = F.lower(F.regexp_extract(last, enc, 2))
    # Size tiers.
    tier = (F.when(size == "nano", "smallest").when(size == "tiny", "small")
            .when(size == "base", "medium").when(size == "large", "largest"))
    return F.struct(
        F.when(is_head, "fine-tuned").when(is_enc, "encoder").otherwise("unknown").alias("type"),
        F.when(is_head, F.lower(F.regexp_extract(last, head, 2))).alias("task_key"),
        F.when(is_head, F.concat_ws("-", F.regexp_extract(last, head, 1),
                                    F.regexp_extract(last, head, 3))).alias("base"),
        F.when(is_head, F.lit(None)).otherwise(tier).alias("size_tier"),
    )


# Patterns and texts of the reply clean-up.
THINK_CLOSED = r"(?is)<(think|thinking|reasoning)>.*?</\1>"
THINK_OPEN = r"(?is)<(think|thinking|reasoning)>.*"
PLANNING = (r"(?i)^\s*(let me (write|draft|provide|give|produce)|okay[,.]?\s*(here'?s|let'?s)|"
            r"here'?s (my |the )?(explanation|answer|response)|i'?ll (write|draft|produce))")
PARAGRAPH = r"(?im)^[^\S\n]*paragraph[^\S\n]*\d+[^\S\n]*[:\-—][^\S\n]*"
UNFINISHED = ("The model didn't produce a finished answer (its response was all reasoning, no final "
              "explanation). Click the pill again to retry, or switch the provider in Cloud Chat Settings.")
MIN_CHARS = 30


def _strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


# Markup that goes.
HEADING = r"(?m)^\s{0,3}#{1,6}\s+"
BOLD = r"\*\*(.+?)\*\*"
BULLET = r"(?m)^\s*[-*]\s+"
BLANK_LINES = r"\n{3,}"


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, not once per use."""
    return F.transform(F.array(value), body)[0]


def strip_meta(text: Column) -> Column:
    """S10. Drop reasoning blocks, up to three planning openers, labels and markup.

    What is left of a text of 30 characters or more must itself have 30,
    else a fixed notice stands in for it.
    """
    def skip_opener(t: Column) -> Column:
        gap = F.instr(t, "\n\n")
        after = bind(_strip(F.substr(t, gap)), lambda a: F.when(F.length(a) >= MIN_CHARS, a))
        return F.when(t.rlike(PLANNING) & (gap > 0), F.coalesce(after, t)).otherwise(t)

    t = _strip(F.regexp_replace(F.regexp_replace(text, THINK_CLOSED, ""), THINK_OPEN, ""))
    for _ in range(3):
        t = bind(t, skip_opener)
    t = _strip(F.regexp_replace(t, PARAGRAPH, ""))
    t = F.regexp_replace(t, HEADING, "")
    t = F.regexp_replace(t, BOLD, "$1")
    t = F.regexp_replace(t, BULLET, "")
    t = F.regexp_replace(t, BLANK_LINES, "\n\n")
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, "").otherwise(bind(t, lambda x: F.when(
        (F.length(x) < MIN_CHARS) & (n >= MIN_CHARS), UNFINISHED).otherwise(x)))


# Phrases that claim a tool run which did not happen, and the nudge marker.
PHANTOM_PHRASES = [
    r"i\s+have\s+(initiated|started|begun|launched|kicked\s+off|triggered|run|ran)",
    r"i'?ll\s+(notify|let\s+you\s+know|update\s+you|provide)",
    r"please\s+stand\s+by",
    r"please\s+wait",
    r"the\s+process\s+(is\s+running|has\s+begun|has\s+started|has\s+completed)",
    r"running\s+the\s+(model|inference|tool)",
    r"inference\s+is\s+(running|now\s+in\s+progress|underway|complete)",
    r"(process|inference|tool|segmentation|job)\s+(is\s+)?(now\s+)?(running|complete(d)?)",
    r"i\s+will\s+(notify|update|provide\s+you|run|launch|kick\s+off)",
    r"stand\s+by",
    r"once\s+(the|it'?s)\s+(inference|process|tool|prediction|complete)",
    r"i'?m\s+(now\s+)?(running|executing|invoking)\s+(the|it|that)",
    r"i\s+am\s+(now\s+)?(running|executing|invoking)\s+(the|it|that)",
    r"tool\s+execution\s+failed\s+on\s+the\s+backend",
    r"endpoint\s+(for\s+)?the\s+inference\s+call\s+was\s+not\s+found",
    r"temporary\s+issue\s+with\s+the\s+service",
    r"(segmentation\s+)?job\s+completed",
    r"job\s*id[:\s]+[a-f0-9]{6,}",
    r"scene\s*id[:\s]+s2[abc]_",
]
PHANTOM = r"(?i)\b(" + "|".join(PHANTOM_PHRASES) + r")\b"
NUDGE_MARKER = "PHANTOM TOOL CALL DETECTED"


def looks_phantom(text: Column) -> Column:
    """S11. The first phrase that claims a tool run, or null."""
    return F.when(text.rlike(PHANTOM), F.regexp_extract(text, PHANTOM, 1))
