"""Substitution models: rate matrices, normalised and exponentiated with NumPy once per distinct time, then joined as rows."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Model:
    """An alphabet, its stationary frequencies and a rate matrix whose rows sum to 0."""

    alphabet: tuple[str, ...]
    freqs: tuple[float, ...]
    rates: tuple[tuple[float, ...], ...]

    @functools.cached_property
    def _eigen(self):
        values, left = np.linalg.eig(np.array(self.rates))
        return values, left, np.linalg.inv(left)

    def transition(self, t: float) -> np.ndarray:
        """P(t): row = from, column = to."""
        values, v, inverse = self._eigen
        return np.abs(((v * np.exp(values * t)) @ inverse).real)

    def rows(self, spark: SparkSession, times: list[float]) -> DataFrame:
        """t, x, y, p for each of the given times: the table to join with branches."""
        data = [(float(t), a, b, float(p)) for t in times for a, row in zip(self.alphabet, self.transition(t)) for b, p in zip(self.alphabet, row)]
        return spark.createDataFrame(data, "t double, x string, y string, p double")


def valid(rates: np.ndarray) -> np.ndarray:
    """Off-diagonal rates as given, the diagonal so that rows sum to 0."""
    r = rates - np.diag(np.diag(rates))
    return r - np.diag(r.sum(axis=1))


def scaled(freqs: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Mean rate 1 under the frequencies."""
    return rates / -(freqs * np.diag(rates)).sum()


def from_rates(alphabet: str | tuple[str, ...], freqs, rates, normalise: bool = True) -> Model:
    f, r = np.asarray(freqs, float), valid(np.asarray(rates, float))
    r = scaled(f, r) if normalise else r
    return Model(tuple(alphabet), tuple(f), tuple(map(tuple, r)))


def from_exchangeabilities(alphabet: str, freqs, symmetric) -> Model:
    """The reversible model of a symmetric matrix (its upper triangle counts) and frequencies: empirical protein models are given
    this way, read from a file with :func:`read_exchangeabilities`."""
    f, s = np.asarray(freqs, float), np.triu(np.asarray(symmetric, float), 1)
    return from_rates(alphabet, f, (s + s.T) * f[None, :])


def read_exchangeabilities(path: str, alphabet: str) -> Model:
    """A model from a text file of a lower triangle of exchangeabilities and then the frequencies, as commonly published."""
    n = len(alphabet)
    numbers = np.array(open(path).read().split()[: n * (n - 1) // 2 + n], float)
    s = np.zeros((n, n))
    s[np.tril_indices(n, -1)] = numbers[: n * (n - 1) // 2]
    f = numbers[n * (n - 1) // 2 :]
    return from_exchangeabilities(alphabet, f / f.sum(), s + s.T)


def jc(alphabet: str | tuple[str, ...], gamma: float = 1.0) -> Model:
    """Equal rates gamma / n, not normalised: P(same) = 1/n + (1 - 1/n) e^(-gamma t)."""
    n = len(alphabet)
    return from_rates(alphabet, [1 / n] * n, np.full((n, n), gamma / n), normalise=False)


def yang() -> Model:
    # A published nucleotide model, in the order A C G T.
    return from_rates("ACGT", [0.308, 0.185, 0.199, 0.308], [[0, 0.139, 0.566, 0.115], [0.232, 0, 0.223, 0.882], [0.877, 0.207, 0, 0.215], [0.115, 0.530, 0.139, 0]])


def three_state() -> Model:
    # A three-state example model.
    return from_rates("VAN", [0.3333] * 3, [[0, 0.2, 0.4], [0.2, 0, 0.6], [0.2, 0.4, 0]])


def gap() -> Model:
    # A two-state model of gap and character.
    return from_rates("GC", [0.1, 0.9], [[0, 0.54], [0.54, 0]])


def gain_loss() -> Model:
    # Published gain and loss rates; the states are presence and absence.
    return from_rates(("true", "false"), [0.5, 0.5], [[0, 0.54], [6.61, 0]])


def with_gap(model: Model, mu: float, lam: float) -> Model:
    """The model with a gap state: deletion at rate mu, insertion of a character at rate lam times its frequency."""
    r, f, n = np.array(model.rates), np.array(model.freqs), len(model.freqs)
    out = np.zeros((n + 1, n + 1))
    out[:n, :n], out[:n, n], out[n, :n] = r, mu, lam * f
    return Model((*model.alphabet, "-"), (*(f * lam / (lam + mu)), mu / (lam + mu)), tuple(map(tuple, valid(out))))


def by_name(name: str) -> Model:
    return {"JC": lambda: jc("ACGT"), "Yang": yang, "SIMPLE_3": three_state, "Gap": gap, "GLOOME1": gain_loss}[name]()
