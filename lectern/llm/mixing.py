"""Mixing to target weights when membership in a domain is soft. DataFrame functions only.

A Gaussian naive Bayes model over simple text measures, fitted on labelled documents, gives each document a posterior
over domains; its tokens count towards every domain in that proportion. Nonnegative document rates are then fitted
by projected-gradient least squares so that the expected tokens of each domain meet their targets. Only sums over
documents, one number for each domain, reach the driver in each step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name
from .linear import sample_labelled

#: Labelled documents of each label to fit on.
SAMPLE_PER_LABEL = 4000
ITERATIONS, TOLERANCE = 40, 1e-4
#: Least variance of a measure within a domain.
LEAST_VARIANCE = 1e-4
ONE_DOMAIN = "all"


def token_count(text: Column) -> Column:
    """White-space separated words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def measures(text: Column) -> list[Column]:
    """What the classifier sees of a text, each about between 0 and 1; square roots spread small shares."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text) + 1
    words = F.split(text, " ")
    share = lambda pattern: F.sqrt(F.regexp_count(text, F.lit(pattern)) / chars)
    return [
        F.log1p(chars) / 12, F.least(chars / F.size(words) / 10, F.lit(2.0)), F.size(F.array_distinct(words)) / F.size(words) / F.greatest(F.lit(0.2), 1 - F.log1p(F.size(words).cast("double")) / 20),
        share("[A-Z]"), share(r"[#$%&*!|@=+<>{}\\]"), share("[0-9]"), (F.octet_length(text) - F.char_length(text)) / chars,
        share("[äöüß]"), share("[éèêëç]"), share("[áíóúñ]"), share("[wkh]"), share("[qux]"), share("[ol]"),
    ]


class DomainModel:
    def __init__(self, domains: list[str], priors: list[float], means: list[list[float]], variances: list[list[float]]):
        self.domains, self.priors, self.means, self.variances = domains, priors, means, variances

    def posteriors(self, f: Column) -> Column:
        """An array of posteriors in the order of ``domains`` from the array of measures."""
        logs = []
        for prior, mean, var in zip(self.priors, self.means, self.variances):
            constant = float(np.log(prior) - 0.5 * np.sum(np.log(var)))
            logs.append(F.lit(constant) - sum(((f[i] - F.lit(m)) * (f[i] - F.lit(m)) * F.lit(0.5 / v) for i, (m, v) in enumerate(zip(mean, var))), F.lit(0.0)))
        # one-element arrays bind what is used again, so that it is computed once
        raised = F.transform(F.array(F.array(*logs)), lambda j: F.transform(j, lambda x: F.exp(x - F.array_max(j))))
        total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, b: a + b)
        return F.transform(raised, lambda r: F.transform(r, lambda x: x / total(r)))[0]


def fit_domains(docs: DataFrame, labelled: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DomainModel:
    """From ``docs`` (id, text) and ``labelled`` (id, domain): a bounded sample of ids of each domain is broadcast to the scan."""
    rows = labelled.where("id is not null and domain is not null").dropDuplicates(["id"])
    sample, counts = sample_labelled(rows, "id", "domain", per_label)
    picked = docs.join(F.broadcast(sample), "id").select("domain", F.array(*measures(F.col("text"))).alias("f"))
    width = len(measures(F.col("text")))
    stats = picked.groupBy("domain").agg(*[F.avg(F.col("f")[i]).alias(f"m{i}") for i in range(width)], *[F.var_pop(F.col("f")[i]).alias(f"v{i}") for i in range(width)]).orderBy("domain").collect()
    if not stats:
        return DomainModel([ONE_DOMAIN], [1.0], [[0.0] * width], [[1.0] * width])
    total = sum(counts[r["domain"]] for r in stats)
    return DomainModel([r["domain"] for r in stats], [counts[r["domain"]] / total for r in stats], [[r[f"m{i}"] for i in range(width)] for r in stats], [[max(r[f"v{i}"], LEAST_VARIANCE) for i in range(width)] for r in stats])


def soft_members(docs: DataFrame, model: DomainModel) -> DataFrame:
    """(id, n_tokens, posterior array) of every row of ``docs`` (id, text)."""
    measured = durable(docs.select("id", token_count(F.col("text")).alias("n_tokens"), F.array(*measures(F.col("text"))).alias("f")), "measures")
    return durable(measured.select("id", "n_tokens", model.posteriors(F.col("f")).alias("posterior")), "posteriors")


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], iterations: int = ITERATIONS) -> tuple[DataFrame, dict[str, float]]:
    """``members`` with a rate of 0 or more for every row, and the expected tokens of each domain at those rates.

    ``targets`` are tokens for each domain; a domain without a target keeps its expected tokens. Rates start at 1 and descend
    the squared misfit. In variables scaled by the root of a document's tokens the gradient step changes a rate by the
    posteriors alone, so documents alike but for their length get alike rates; the misfit is weighted by the inverse
    of the Gram matrix in these variables, so a step of 1 suits all directions. After each step negative rates become
    0. Targets that no rates can reach are met as near as least squares can.
    """
    d = len(domains)
    share = [F.col("posterior")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    first = members.agg(*[F.sum(F.col("n_tokens") * p) for p in share], *[F.sum(F.col("n_tokens") * share[i] * share[j]) for i, j in pairs]).first()
    now = np.array([x or 0.0 for x in first[:d]])
    gram = np.zeros((d, d))
    for (i, j), x in zip(pairs, first[d:]):
        gram[i, j] = gram[j, i] = x or 0.0
    weigh = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    wanted = np.array([float(targets.get(name, have)) for name, have in zip(domains, now)])
    scale = max(float(np.abs(wanted).sum()), 1.0)
    rated = members.withColumn("rate", F.lit(1.0))
    for step in range(iterations):
        if np.abs(now - wanted).max() <= TOLERANCE * scale:
            break
        change = sum((p * F.lit(float(x)) for p, x in zip(share, weigh @ (now - wanted))), F.lit(0.0))
        rated = rated.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - change))
        if step % 4 == 3:  # keeps the expression, and so the generated code, short
            rated = durable(rated, "rates")
        now = np.array([x or 0.0 for x in rated.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * p) for p in share]).first()])
    return rated, dict(zip(domains, map(float, now)))


def unit(id_col: Column) -> Column:
    """A number in 0..1 that depends on the id alone."""
    return F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)


def mix(docs: DataFrame, labelled: DataFrame, shares: dict[str, float] | None = None, factors: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, domain, posterior, rate, copies, targets_met) of every row of ``docs``.

    ``shares`` are target shares of all tokens for each domain; a domain without one keeps its tokens, and the shares are
    rescaled to divide all others. Or ``factors`` multiply the tokens a domain has now, 1 where absent. ``targets_met`` tells
    whether all expected tokens came within ``TOLERANCE`` of the targets, which is not so where no rates can do it. ``domain`` is the likeliest and ``posterior`` its posterior. ``copies`` realises the
    rate: its whole part, and one more with the chance of the rest, decided by the id. Null texts count as empty;
    they have no tokens, so their rate stays 1. Without labelled rows all is one domain.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit_domains(rows, labelled)
    members = soft_members(rows, model)
    d = len(model.domains)
    have = [float(x or 0) for x in members.agg(*[F.sum(F.col("posterior")[i] * F.col("n_tokens")) for i in range(d)]).first()]
    targets = dict(zip(model.domains, have))
    if shares:
        known = {k: v for k, v in shares.items() if k in targets}
        divided, whole = sum(targets[k] for k in known), sum(known.values()) or 1.0
        targets |= {k: divided * v / whole for k, v in known.items()}
    else:
        targets = {k: h * (factors or {}).get(k, 1.0) for k, h in targets.items()}
    rated, reached = fit_rates(members, model.domains, targets)
    met = max(abs(reached[k] - t) for k, t in targets.items()) <= TOLERANCE * max(sum(targets.values()), 1.0)
    best = F.array_max("posterior")
    copies = F.floor(F.col("rate") + unit(F.col("id"))).cast("int")
    return rated.select(F.col("id").alias(id_col), "n_tokens", F.element_at(F.array(*map(F.lit, model.domains)), F.array_position("posterior", best).cast("int")).alias("domain"), best.alias("posterior"), "rate", copies.alias("copies"), F.lit(met).alias("targets_met"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", full: float = 0.95) -> DataFrame:
    """The rows of ``docs`` that the rates keep, each once: all with a rate of ``full`` or more, others with that chance."""
    spare = free_name(docs.columns, "mixed_id")
    gone = mixed.where((F.col("rate") < full) & (F.col("rate") <= unit(F.col(id_col)))).select(F.col(id_col).alias(spare)).distinct()
    return docs.join(gone, docs[id_col] == gone[spare], "left_anti")
