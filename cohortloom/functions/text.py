"""Column functions over names and texts of the drug vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of salts and hydrates that are dropped from drug names.
SALT_WORDS = (
    "hydrochloride dihydrochloride monohydrochloride hcl besylate besilate benzenesulfonate maleate fumarate succinate tartrate mesylate tosylate acetate gluconate citrate "
    "bromide chloride sulfate phosphate nitrate potassium monopotassium dipotassium sodium monosodium disodium calcium magnesium zinc anhydrous trihydrate dihydrate "
    "monohydrate pentahydrate sesquihydrate hydrate salt free base"
).split()

# Parts of action texts that tell the direction of an effect.
NEGATIVE = ["antagonist", "inhibitor", "blocker", "negative", "suppressor", "inverse agonist", "degrader", "downregulator", "inactivator"]
POSITIVE = ["agonist", "activator", "positive", "inducer", "potentiator", "stimulator", "opener", "enhancer"]
ACTION_NEGATIVE = ["INHIBITOR", "ANTAGONIST", "BLOCKER", "SUPPRESSOR", "NEGATIVE", "INVERSE", "DEGRADER"]
ACTION_POSITIVE = ["ACTIVATOR", "AGONIST", "OPENER", "STIMULATOR", "POSITIVE", "REPLACEMENT"]

# Order of trust in affinity types; any other type comes last.
AFFINITY_ORDER = {"KD": 1, "KI": 2, "IC50": 3}


def normalized_name(name: Column, modifiers: list[str] = SALT_WORDS) -> Column:
    """Lower-case base name without bracketed parts, punctuation and modifier words; the whole text where only those remain. Null gives ''."""
    text = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\S\n]", " ")
    bare = F.regexp_replace(F.regexp_replace(text, r"\([^)\n]*\)", ""), r"[,;:\-_/]", " ")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*modifiers))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.trim(bare))


def effect_direction(action: Column, mechanism: Column) -> Column:
    """-1 or +1 from both texts; negative words come first, and silence counts as -1."""
    text = F.lower(F.concat_ws(" ", F.coalesce(action, F.lit("")), F.coalesce(mechanism, F.lit(""))))
    return F.when(text.rlike("|".join(NEGATIVE)), -1).when(text.rlike("|".join(POSITIVE)), 1).otherwise(-1)


def action_direction(action: Column) -> Column:
    """-1, +1 or 0 from the action type alone."""
    text = F.upper(F.coalesce(action, F.lit("")))
    return F.when(text.rlike("|".join(ACTION_NEGATIVE)), -1.0).when(text.rlike("|".join(ACTION_POSITIVE)), 1.0).otherwise(0.0)


def resolved_direction(direction: Column, action: Column) -> Column:
    """A given direction of -1 or +1, else the one of the action type."""
    given = direction.cast("string").try_cast("double")
    return F.when(given.isin(-1.0, 1.0), given).otherwise(action_direction(action))


def effective_direction(direction: Column) -> Column:
    return F.when(direction == 0, -1.0).otherwise(direction)


def potency_score(affinity: Column, cutoff: float = 10_000.0, default: float = 100.0) -> Column:
    """9 - log10(affinity in nM): unknown counts as ``default``, zero or less as 0.1, beyond ``cutoff`` as 0."""
    known = F.when(affinity.isNull() | F.isnan(affinity), F.lit(default)).when(affinity <= 0, F.lit(0.1)).otherwise(affinity)
    return F.when(known > cutoff, 0.0).otherwise(F.greatest(F.lit(0.0), 9 - F.log10(known)))


def affinity_priority(kind: Column) -> Column:
    out = F.lit(4)
    for name, rank in AFFINITY_ORDER.items():
        out = F.when(F.upper(kind) == name, rank).otherwise(out)
    return out


def protein_accession(uniprot: Column) -> Column:
    """Accession without isoform suffix and surrounding blanks."""
    return F.split_part(F.trim(uniprot), F.lit("-"), F.lit(1))


def atc_family(code: Column) -> Column:
    return F.substring(F.upper(code), 1, 5)
