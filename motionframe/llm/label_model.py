"""Label model for weak supervision: accuracies of voting rules by expectation-maximisation.

The input is the table of distinct vote patterns with their row counts, gathered by Spark over all rows; it has
at most ``3 ** rules`` rows whatever the corpus size, so the iterations run on the driver.  A vote is 1, 0 or -1
(abstain).  Each rule has, for either class, a probability of voting and of voting right; rules are taken as
independent given the class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

#: What is taken as given about a rule before its votes are seen, for class 0 and 1: chance of vote 0, 1, none.
PRIOR_RATES = ((0.25, 0.08, 0.67), (0.02, 0.50, 0.48))
#: Weight of that prior, as a share of the rows, so that it counts alike at every corpus size.
PRIOR_WEIGHT = 0.1


@dataclass(frozen=True)
class LabelModel:
    prior: float
    #: rates[rule][class][vote]: probability of vote 0, 1 or abstaining (index 2) in that class
    rates: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]
    #: whether abstaining tells anything, by how often a rule does so in either class
    silence_counts: bool = False

    def posterior(self, votes: tuple[int, ...]) -> float:
        """Probability of class 1 given the votes; abstentions are no evidence unless ``silence_counts``."""
        log_odds = math.log(self.prior) - math.log(1 - self.prior)
        for rule, vote in zip(self.rates, votes, strict=True):
            if vote >= 0 or self.silence_counts:
                log_odds += math.log(rule[1][vote]) - math.log(rule[0][vote])  # -1 is the last rate, that of abstaining
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, log_odds))))

    def accuracy(self, rule: int) -> float:
        """How often the rule is right where it votes."""
        right = (1 - self.prior) * self.rates[rule][0][0] + self.prior * self.rates[rule][1][1]
        votes = right + (1 - self.prior) * self.rates[rule][0][1] + self.prior * self.rates[rule][1][0]
        return right / votes


def fit(patterns: dict[tuple[int, ...], int], rules: int, iterations: int = 50, least_prior: float = 0.01, silence_counts: bool = False) -> LabelModel:
    """Estimate the model from ``{votes: rows}``; with no rows its prior is a coin flip."""
    weight = {v: float(n) for v, n in patterns.items()}
    model = LabelModel(0.5, (PRIOR_RATES,) * rules, silence_counts)
    belief = {v: model.posterior(v) for v in weight}
    for _ in range(iterations):
        total = sum(weight.values())
        positive = sum(weight[v] * belief[v] for v in weight)
        prior = min(1 - least_prior, max(least_prior, positive / total)) if total else 0.5
        rates = []
        for rule in range(rules):
            counts = [[max(1.0, PRIOR_WEIGHT * total) * rate for rate in PRIOR_RATES[c]] for c in (0, 1)]
            for votes, n in weight.items():
                vote = votes[rule] if votes[rule] >= 0 else 2
                counts[1][vote] += n * belief[votes]
                counts[0][vote] += n * (1 - belief[votes])
            rates.append(tuple(tuple(x / sum(row) for x in row) for row in counts))
        before, model = model, LabelModel(prior, tuple(rates), silence_counts)
        belief = {v: model.posterior(v) for v in weight}
        if abs(before.prior - model.prior) < 1e-9 and _moved(before, model) < 1e-7:
            break
    return model


def _moved(a: LabelModel, b: LabelModel) -> float:
    return max((abs(x - y) for p, q in zip(a.rates, b.rates, strict=True) for r, s in zip(p, q, strict=True) for x, y in zip(r, s, strict=True)), default=0.0)


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic regression over the kind of a span and its votes; an abstention has weight 0."""

    bias: float
    kinds: dict[str, float]
    #: weights of a vote 0 and a vote 1 of each labeler
    votes: tuple[tuple[float, float], ...]


def fit_classifier(rows: list[tuple[str, tuple[int, ...], int, float]], kinds: list[str], labelers: int, steps: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> SpanClassifier:
    """Fit to ``(kind, votes, rows, probability)`` patterns by gradient descent on the expected log-loss.

    Every pattern weighs by the root of its rows, so that rare patterns are learned too.  Without patterns all
    weights are 0.
    """
    place = {k: i + 1 for i, k in enumerate(kinds)}
    size = 1 + len(kinds) + 2 * labelers
    examples = []
    for kind, votes, n, target in rows:
        active = [0, place[kind], *(1 + len(kinds) + 2 * k + v for k, v in enumerate(votes) if v >= 0)]
        examples.append((active, math.sqrt(n), target))
    total = sum(weight for _, weight, _ in examples)
    w = [0.0] * size
    for _ in range(steps if examples else 0):
        gradient = [ridge * x for x in w]
        for active, weight, target in examples:
            error = (1 / (1 + math.exp(-max(-40.0, min(40.0, sum(w[i] for i in active))))) - target) * weight / total
            for i in active:
                gradient[i] += error
        w = [x - rate * g for x, g in zip(w, gradient, strict=True)]
    first = 1 + len(kinds)
    return SpanClassifier(w[0], {k: w[i] for k, i in place.items()}, tuple((w[first + 2 * k], w[first + 2 * k + 1]) for k in range(labelers)))
