"""Severity scores from CVSS 3 vectors, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public CVSS 3.1 specification.
WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"N": 0.0, "L": 0.22, "H": 0.56},
    "I": {"N": 0.0, "L": 0.22, "H": 0.56},
    "A": {"N": 0.0, "L": 0.22, "H": 0.56},
}
PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
# End of the fixed values.


def _metric(vector: Column, name: str) -> Column:
    """The last value of a metric, null without one."""
    return F.regexp_extract(vector, rf"(?s)^.*/{name}:([^/]*)", 1)


def _weight(value: Column, weights: dict[str, float]) -> Column:
    """A look-up in a literal map, in which the value stands once; null for unknown values."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), value)


def base_score(vector: Column | str) -> Column:
    """The base score 0.0 to 10.0; null for null, other generations, missing metrics and unknown values. Of a metric
    given twice the last value counts."""
    v = F.col(vector) if isinstance(vector, str) else vector
    w = {m: _weight(_metric(v, m), table) for m, table in WEIGHTS.items()}
    scope = _metric(v, "S")
    changed = F.when(scope == "C", F.lit(True)).when(scope == "U", F.lit(False))
    privilege = _weight(F.concat(scope, _metric(v, "PR")), {s + k: w for s, table in PRIVILEGES.items() for k, w in table.items()})
    sub = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    reach = 8.22 * w["AV"] * w["AC"] * privilege * w["UI"]
    impact = F.when(changed, 7.52 * (sub - 0.029) - 3.25 * F.pow(sub - 0.02, F.lit(15.0))).otherwise(6.42 * sub)
    raw = F.least(F.when(changed, 1.08 * (impact + reach)).otherwise(impact + reach), F.lit(10.0))
    score = F.least(F.floor(raw * 10 + 0.999999) / 10, F.lit(10.0))
    return F.when(v.startswith("CVSS:3.") & changed.isNotNull() & reach.isNotNull() & sub.isNotNull(), F.when(sub <= 0, F.lit(0.0)).otherwise(score))


def severity(score: Column) -> Column:
    return F.when(score.isNull(), "Not assessed").when(score >= 9, "Critical").when(score >= 7, "High").when(score >= 4, "Medium").when(score > 0, "Low").otherwise("None")


def high_severity(label: Column, vector: Column) -> Column:
    """By the label where there is one, else by a score of 7 or more."""
    return F.when(F.coalesce(label, F.lit("")) != "", F.upper(label).isin("HIGH", "CRITICAL")).otherwise(F.coalesce(base_score(vector), F.lit(0.0)) >= 7.0)


def below_gate(vector: Column, threshold: float | None) -> Column:
    """True where a score is known and under the threshold; a threshold that is null or not above 0 holds nothing back."""
    if not threshold or threshold <= 0:
        return F.lit(False)
    return F.coalesce(base_score(vector) < threshold, F.lit(False))
