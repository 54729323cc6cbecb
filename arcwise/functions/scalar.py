"""Scalar expressions; all stay within the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def degree_weight(d: Column, kind: str = "logdegree") -> Column:
    """How specific a node of degree d is: 1/(1+d) for 'degree', 1/(1+ln d) for 'logdegree'."""
    if kind == "degree":
        return 1.0 / (1.0 + d)
    if kind == "logdegree":
        return 1.0 / (1.0 + F.ln(d.cast("double")))
    raise ValueError(f"weight must be 'degree' or 'logdegree', not {kind!r}")


def softmax(score: Column, *by: str, shifted: bool = True) -> Column:
    """exp(score) over its sum within `by`. Shifted by the largest score it equals the plain form where that is finite;
    unshifted, large scores give NaN."""
    w = Window.partitionBy(*by)
    e = F.exp(score - F.max(score).over(w)) if shifted else F.exp(score)
    return e / F.sum(e).over(w)


def link_entropy(ka: Column, kb: Column, m: Column) -> Column:
    """-log2(1 - prod_{i<kb} (m-ka-i)/(m-i)): the surprise of a link between nodes of degrees ka and kb among m links.

    Where the links run out (i reaches m, as with a self-loop at a hub) a link is certain and the entropy 0.
    """
    i = F.sequence(F.lit(0).cast("long"), kb.cast("long") - 1)
    none = F.aggregate(i, F.lit(1.0), lambda acc, k: acc * F.greatest(F.lit(0.0), (m - ka - k).cast("double")) / F.greatest(F.lit(1.0), (m - k).cast("double")))
    return -F.log2(1.0 - none)


def rendered(nodes: Column, relations: Column) -> Column:
    """A path as text: 3 -[1]-> 0 -[5]-> 4; relations lead with -1."""
    steps = F.zip_with(nodes, relations, lambda n, r: F.when(r == -1, n.cast("string")).otherwise(F.concat(F.lit("-["), r.cast("string"), F.lit("]-> "), n.cast("string"))))
    return F.array_join(steps, " ")
