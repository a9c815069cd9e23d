"""Raw labels to categories, techniques, tokens, lanes and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import STAGES

UNRESOLVED = "UNKNOWN"
# Parts of a raw label, in the order they are looked for, with category and technique.
BOTNET_PARTS = (("botnet", "C2", "T1071"), ("normal", "Benign", None), ("background", "Benign", None), ("benign", "Benign", None))
LABEL_PARTS = (
    ("benign", "Benign", None), ("normal", "Benign", None), ("portscan", "Recon", "T1046"), ("scanning", "Recon", "T1046"), ("recon", "Recon", "T1046"), ("ddos", "Impact", "T1498"), ("dos", "Impact", "T1498"),
    ("bot", "C2", "T1071"), ("brute", "InitialAccess", "T1110"), ("patator", "InitialAccess", "T1110"), ("infilt", "InitialAccess", "T1190"),
)
# Categories with the techniques and words that stand for them, in the order they are looked for.
MACRO = (
    ("Recon", "T1595", ("T1595", "T1046"), ("Recon",), ()),
    ("Impact", "T1498", ("T1498",), ("Impact",), ("dos",)),
    ("CredentialAccess", "T1110", ("T1110",), ("CredentialAccess",), ("brute", "patator")),
    ("InitialAccess", "T1190", ("T1190", "T1189"), ("InitialAccess",), ()),
    ("C2", "T1071", ("T1071", "T1568", "T1204"), ("C2", "Execution"), ()),
    ("Exfiltration", "T1005", ("T1005", "T1020"), ("Exfiltration",), ()),
)
# The token vocabulary.
TOKENS = ("<PAD>", "<BOS>", "<EOS>", "Benign.None", *[f"{c}.{t}" for c, t, *_ in MACRO])
# Level of each category; 0 for others.
LEVELS = {"Benign": 0, "Recon": 1, "InitialAccess": 2, "Execution": 2, "C2": 3, "LateralMovement": 3, "Exfiltration": 3, "Impact": 3, "Unknown": 1, "UNKNOWN": 1}


def normal_label(label: Column) -> Column:
    """Dashes of all kinds made plain, white space collapsed, lower case."""
    dashed = F.regexp_replace(label, "[‐-―−�\u0096\u0097]", "-")
    return F.lower(F.trim(F.regexp_replace(dashed, r"\s+", " ")))


def _resolved(category: str, technique: str | None) -> Column:
    techniques = F.array(F.lit(technique)) if technique else F.array().cast("array<string>")
    return F.struct(F.lit(category).alias("category"), techniques.alias("techniques"), F.lit(category not in ("Benign", UNRESOLVED)).alias("is_attack"))


def _first_part(label: Column, parts, start: Column | None = None) -> Column | None:
    out = start
    for part, category, technique in parts:
        hit = label.contains(part)
        out = F.when(hit, _resolved(category, technique)) if out is None else out.when(hit, _resolved(category, technique))
    return out


def guessed_label(label: Column, botnet: bool = False, keep_background: bool = True) -> Column:
    """What a raw label means by the words in it, as a struct; ``UNKNOWN`` if none is known or there is no label.

    ``botnet`` also knows the words of botnet captures; there, background traffic counts as benign unless told otherwise.
    """
    parts = BOTNET_PARTS if keep_background else (BOTNET_PARTS[0], ("background", UNRESOLVED, None), *BOTNET_PARTS[1:])

    def of(text: Column) -> Column:
        return _first_part(text, LABEL_PARTS, _first_part(text, parts) if botnet else None).otherwise(_resolved(UNRESOLVED, None))

    # A one-element transform names the text, so that it is made once and not for each word and each field.
    return F.get(F.transform(F.array(normal_label(label)), of), 0)


def resolve_labels(df: DataFrame, label: str, labels: DataFrame, botnet: bool = False, name: str = "resolved") -> DataFrame:
    """``df`` with the meaning of its labels: as ``labels`` (raw_label, coarse_category, attck_technique_ids, is_attack) has it, else by its words.

    ``labels`` is a table of label names; it is broadcast if its size allows, which is for Spark to judge.
    """
    known = labels.select(
        normal_label(F.col("raw_label")).alias("known label"),
        F.struct(F.col("coarse_category").alias("category"), F.filter(F.split(F.coalesce("attck_technique_ids", F.lit("")), ";"), lambda x: x != "").alias("techniques"), F.col("is_attack").cast("boolean").alias("is_attack")).alias("known"),
    ).dropDuplicates(["known label"])
    found = df.join(known, normal_label(F.col(label)) == F.col("known label"), "left")
    return found.withColumn(name, F.coalesce("known", guessed_label(F.col(label), botnet))).drop("known label", "known")


def macro_token(category: Column, technique: Column) -> Column:
    """Category and technique as one of six macro techniques, or ``Benign.None``."""
    text, tech = F.coalesce(F.trim(category), F.lit("Benign")), F.coalesce(F.trim(technique), F.lit(""))
    tech = F.when(tech == "None", "").otherwise(tech)
    out = F.when(F.lower(text).isin("benign", "normal", "background", "unknown") & (tech == ""), "Benign.None")
    for name, canonical, techniques, names, words in MACRO:
        hit = text.isin(*names)
        for t in techniques:
            hit = hit | tech.contains(t)
        for word in words:
            hit = hit | F.lower(text).contains(word)
        out = out.when(hit, f"{name}.{canonical}")
    return out.otherwise("Benign.None")


def token_id(token: Column) -> Column:
    """Position in the vocabulary; that of ``Benign.None`` for other tokens."""
    at = F.array_position(F.array(*[F.lit(t) for t in TOKENS]), token) - 1
    return F.when(at >= 0, at).otherwise(TOKENS.index("Benign.None")).cast("int")


def token_of(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in TOKENS]), number), F.lit("Benign.None"))


def lane(label: Column) -> Column:
    """Lane of a technique or a token, ``Benign`` if it has none."""
    text = F.trim(F.coalesce(label, F.lit("")))
    technique = text.rlike(r"^T\d")
    token = macro_token(F.when(technique, "").otherwise(F.split_part(text, F.lit("."), F.lit(1))), F.when(technique, text).otherwise(F.regexp_extract(text, r"^[^.]*\.(.*)$", 1)))
    return F.when((text == "") | (text == "Benign") | text.startswith("Benign."), "Benign").otherwise(F.split_part(token, F.lit("."), F.lit(1)))


def lane_rank(name: Column) -> Column:
    """Place in an attack's course from 0, -1 for none."""
    return (F.array_position(F.array(*[F.lit(s) for s in STAGES]), name) - 1).cast("int")


def level(category: Column) -> Column:
    out = F.lit(0)
    for name, value in LEVELS.items():
        out = F.when(category == name, value).otherwise(out)
    return out
