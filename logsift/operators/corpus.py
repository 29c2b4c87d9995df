"""Labelled log corpus derived deterministically from an id-keyed table.

The reference produces its labelled logs with a random simulator.  Here the
same ideas are DataFrame operators over an existing table keyed by an id:

* D1 ``weighted_mix``: class by md5 bucket against cumulative weights,
* D2 ``render_logs``: one message per row from a template and slot values,
* D3 ``ambiguous_share``: a second bucket picks the overlapping wording,
* D4 ``train_test_split``: a third bucket splits train / test,
* D5 ``class_mix_resample``: keep fractions that reach a target class mix.

Every value comes from ``bucket(id, salt)``, so a row gets the same record on
every run, partitioning and retry.  Everything is a column expression: no
shuffle, one pass, whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.constants import (AMBIGUOUS_SHARE, BUCKETS, CLASS_WEIGHTS, CLASSES,
                               SOURCES, TRAIN_SHARE)
from logsift.functions.buckets import bucket, bucket_text, pick_text, weighted_pick_text
from logsift.functions.text import sql_literal

# --- message wording (this project's own) ------------------------------------

# Clear wording per class: the control room of a greenhouse.
CLEAR_TEMPLATES = {
    "noise": [
        "{shift} round in {hall} done, {trays} trays counted",
        "valve of bed {plot} opened and closed on plan {plan}",
    ],
    "error": [
        "{fault} stopped {machine}",
        "{machine} halted in {hall}: {fault} after {seconds}s",
    ],
    "security": [
        "{intrusion} seen at {gate} during {shift} round",
        "guard called to {gate}: {intrusion}, badge {badge}",
    ],
    "warning": [
        "{strain} near {machine}, reading {reading}",
        "bed {plot} drifting to {reading} while {machine} runs",
    ],
}

# Wording that shares terms with other classes.
AMBIGUOUS_TEMPLATES = {
    "noise": [
        "badge {badge} passed {gate} at second try",
        "{machine} stopped for cleaning of {hall}",
    ],
    "error": [
        "no answer of {machine} in {hall}",
        "badge reader of {gate} stopped",
    ],
    "security": [
        "badge {badge} tried {gate} outside {shift} round",
        "cover of {machine} opened by badge {badge}",
    ],
    "warning": [
        "second start of {machine} needed",
        "no answer of bed {plot} for {seconds}s, reading {reading}",
    ],
}

# Slot values, and slots of numbers in [base, base + span).
SLOT_CHOICES = {
    "shift": ["early", "late", "night"],
    "hall": ["tomato hall", "herb hall", "palm house", "seed store"],
    "plan": ["drip", "mist", "flood"],
    "machine": ["belt drive", "lamp crane", "soil mixer", "pump two"],
    "fault": ["torn belt", "burnt fuse", "dead sensor", "jammed arm"],
    "intrusion": ["forced door", "cut fence", "cloned badge"],
    "strain": ["rising heat", "falling level", "growing hum", "thin air"],
    "gate": ["north gate", "yard gate", "roof hatch"],
}
SLOT_NUMBERS = {
    "trays": (12, 300),
    "seconds": (3, 90),
    "reading": (40, 160),
    "badge": (20000, 5000),
    "plot": (1, 480),
}

_SLOT = re.compile(r"\{(\w+)\}")


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a template into ("lit", text) and ("slot", name) parts."""
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(("lit", template[pos:m.start()]))
        parts.append(("slot", m.group(1)))
        pos = m.end()
    if pos < len(template):
        parts.append(("lit", template[pos:]))
    return parts


# Expressions are SQL text, parsed once: a message has a branch for every
# template, which is slow to assemble call by call.

def slot_text(name: str) -> str:
    """Slot value from the row's bucket column ``_b_<name>``."""
    if name in SLOT_NUMBERS:
        base, span = SLOT_NUMBERS[name]
        return f"cast({base} + _b_{name} % {span} AS string)"
    return pick_text(f"_b_{name}", SLOT_CHOICES[name])


def slot_names() -> list[str]:
    return list(SLOT_NUMBERS) + list(SLOT_CHOICES)


def render_text(template: str) -> str:
    """Template over the slot columns ``_s_<name>``."""
    return "concat(" + ", ".join(sql_literal(v) if k == "lit" else f"_s_{v}" for k, v in template_parts(template)) + ")"


# --- D1 .. D3 ------------------------------------------------------------------

def class_text(bucket: str) -> str:
    """Class by weight (noise .70, error .15, security .05, warning .10)."""
    return weighted_pick_text(bucket, CLASSES, CLASS_WEIGHTS)


def ambiguous_text(key: str) -> str:
    """D3: 20 % of every class uses the overlapping wording."""
    return f"{bucket_text(key, 'ambiguous')} < {int(round(AMBIGUOUS_SHARE * BUCKETS))}"


def message_text(label: str, ambiguous: str, template_bucket: str) -> str:
    """The message of the row's class and wording family."""
    whens = []
    for cls in CLASSES:
        for family, amb in ((CLEAR_TEMPLATES, "false"), (AMBIGUOUS_TEMPLATES, "true")):
            for i, t in enumerate(family[cls]):
                whens.append(f"WHEN {label} = '{cls}' AND {ambiguous} = {amb} AND {template_bucket} % {len(family[cls])} = {i} "
                             f"THEN {render_text(t)}")
    return f"CASE {' '.join(whens)} END"


def level_text(label: str) -> str:
    """``INFO`` for noise, otherwise the upper-cased class."""
    return f"CASE WHEN {label} = 'noise' THEN 'INFO' ELSE upper({label}) END"


# ISO-8601 with microseconds and a ``+00:00`` offset.
ISO_UTC = r"yyyy-MM-dd\'T\'HH:mm:ss.SSSSSS\'+00:00\'"


def log_view(events: DataFrame, key: str = "event_id", time_col: str = "ts", carry: tuple[str, ...] = ()) -> DataFrame:
    """Labelled log records, one per input row.

    Columns: ``rid`` (the source key), ``log_id`` (sha-256 of the key: stable
    under recomputation and replay, unlike a random UUID), ``event_time``,
    ``timestamp`` (ISO text), ``source``, ``level``, ``message``,
    ``true_label``, ``ambiguous``; and the columns named in ``carry``.

    Three narrow projections: every md5 bucket once, then every slot value
    once, then the message; no shuffle.
    """
    more = [f"`{c}`" for c in carry]
    b = events.selectExpr(
        f"`{key}` AS rid", f"`{time_col}` AS event_time", f"{bucket_text(f'`{key}`', 'class')} AS _bc",
        f"{ambiguous_text(f'`{key}`')} AS ambiguous", f"{bucket_text(f'`{key}`', 'template')} AS _tb",
        f"{pick_text(bucket_text(f'`{key}`', 'source'), SOURCES)} AS source", *more,
        *[f"{bucket_text(f'`{key}`', n)} AS _b_{n}" for n in slot_names()])
    slots = b.selectExpr("rid", "event_time", f"{class_text('_bc')} AS true_label", "ambiguous", "_tb", "source", *more,
                         *[f"{slot_text(n)} AS _s_{n}" for n in slot_names()])
    return slots.selectExpr(
        "rid", "sha2(cast(rid AS string), 256) AS log_id", "event_time",
        f"date_format(event_time, '{ISO_UTC}') AS timestamp", "source", f"{level_text('true_label')} AS level",
        f"{message_text('true_label', 'ambiguous', '_tb')} AS message", "true_label", "ambiguous", *more)


LABELLED_COLUMNS = ["timestamp", "source", "level", "message", "true_label"]


# --- D4 / D5 -------------------------------------------------------------------

def split_of(key: str, train_share: float = TRAIN_SHARE) -> Column:
    """``train`` / ``test`` by bucket; stable under reruns."""
    cut = int(round(train_share * BUCKETS))
    return F.expr(f"CASE WHEN {bucket_text(f'`{key}`', 'split')} < {cut} THEN 'train' ELSE 'test' END")


def class_mix_resample(df: DataFrame, label: str, key: str,
                       target: dict[str, float]) -> DataFrame:
    """Keep a deterministic subset whose class mix equals ``target``.

    Without replacement the largest reachable size is ``min_c n_c / t_c``;
    class ``c`` keeps the fraction ``t_c * size / n_c`` of its rows, chosen by
    md5 bucket.  The class counts are one small aggregate (one row per class,
    broadcast back); classes not in ``target`` are dropped.
    """
    tgt = df.sparkSession.createDataFrame(
        [(c, float(w)) for c, w in target.items()], f"{label} string, target double")
    counts = (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .join(F.broadcast(tgt), label))
    # A window over the class table only (one row per class).
    size = F.min(F.col("n") / F.col("target")).over(Window.partitionBy())
    frac = counts.select(label, (F.col("target") * size / F.col("n")).alias("keep"))
    return (df.join(F.broadcast(frac), label)
            .where(bucket(F.col(key), "resample") < F.col("keep") * F.lit(BUCKETS))
            .drop("keep"))
