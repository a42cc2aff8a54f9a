"""Contracts of the JSON documents that runs leave behind: one set of rule builders, one table of rules per document.

A rule is a function from a document to the messages of what is wrong; nothing here knows about policies, only about structure: fields, finite
numbers, digests, fractions, monotone percentiles, counts that add up.
"""

from __future__ import annotations

import math
import re
import subprocess
from collections.abc import Callable, Iterable, Sequence

Rule = Callable[[dict], Iterable[str]]
_DIGEST = re.compile(r"[0-9a-f]{64}")


def at(document: dict, path: str):
    """The value under a dotted path, or None."""
    value = document
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


def required(*paths: str) -> Rule:
    return lambda d: (f"{p} is missing" for p in paths if at(d, p) is None)


def only(path: str, names: Sequence[str]) -> Rule:
    return lambda d: (f"{path}.{n} is not expected" for n in sorted(set(at(d, path) or {}) - set(names)))


def numbers(*paths: str, least: float = -math.inf, most: float = math.inf) -> Rule:
    return lambda d: (f"{p} must be a number from {least} to {most}" for p in paths if at(d, p) is not None and not (is_number(at(d, p)) and least <= at(d, p) <= most))


def counts(*paths: str) -> Rule:
    return lambda d: (f"{p} must be a whole number of at least 0" for p in paths if at(d, p) is not None and not (type(at(d, p)) is int and at(d, p) >= 0))


def digests(*paths: str) -> Rule:
    return lambda d: (f"{p} must be a SHA-256" for p in paths if at(d, p) is not None and not _DIGEST.fullmatch(str(at(d, p))))


def distinct(*paths: str) -> Rule:
    def check(d: dict) -> Iterable[str]:
        values = [at(d, p) for p in paths if at(d, p) is not None]
        return [f"{', '.join(paths)} must differ"] if len(set(map(str, values))) != len(values) else []

    return check


def rising(*paths: str) -> Rule:
    """Values that must not fall, such as percentiles."""

    def check(d: dict) -> Iterable[str]:
        values = [at(d, p) for p in paths]
        return [f"{', '.join(paths)} must not fall"] if all(map(is_number, values)) and any(a > b for a, b in zip(values, values[1:])) else []

    return check


def adds_up(total: str, parts: str, field: str | None = None) -> Rule:
    """The numbers below ``parts`` (a map or list, or one field of its members) sum to ``total``."""

    def check(d: dict) -> Iterable[str]:
        members = at(d, parts)
        if members is None or at(d, total) is None:
            return []
        values = [m if field is None else m.get(field) for m in (members.values() if isinstance(members, dict) else members)]
        return [] if all(map(is_number, values)) and math.isclose(sum(values), at(d, total), rel_tol=1e-9) else [f"{parts} must add up to {total}"]

    return check


def equal(path: str, value) -> Rule:
    return lambda d: [] if at(d, path) == value else [f"{path} must be {value!r}"]


def each(path: str, *rules: Rule) -> Rule:
    """Rules for every member of a map or list."""

    def check(d: dict) -> Iterable[str]:
        members = at(d, path) or {}
        named = members.items() if isinstance(members, dict) else enumerate(members)
        return [f"{path}.{n}: {message}" for n, m in named for rule in rules for message in rule(m)]

    return check


_RATES = [f"metrics.{n}" for n in ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "brier")]
_LATENCY = (required("n", "p50_ms", "p95_ms", "p99_ms", "max_ms"), counts("n"), numbers("mean_ms", "max_ms", least=0), rising("p50_ms", "p95_ms", "p99_ms", "max_ms"))

RULES: dict[str, tuple[Rule, ...]] = {
    "audit": (required("labels", "pairs", "question_ids", "checks", "status"), counts("labels.n_rows", "labels.n_invalid"), numbers("labels.positive_rate", least=0, most=1)),
    "roles": (required("seed", "roles"), each("roles", required("n_rows", "components"), counts("n_rows", "negatives", "positives"), numbers("observed_fraction", least=0, most=1))),
    "report": (
        required("threshold", "threshold_source", "metrics", "sweep", "calibration.ece"), numbers("threshold", *_RATES, "calibration.ece", least=0, most=1), numbers("metrics.log_loss", least=0),
        adds_up("metrics.n", "calibration.bins", "n"), each("slices", numbers("accuracy", "accuracy_low", "accuracy_high", least=0, most=1), rising("accuracy_low", "accuracy", "accuracy_high")),
    ),
    "retrieval": (required("metrics", "seconds"), each("metrics", counts("k", "n_queries"), numbers("recall", "mrr", "ndcg", "hit_rate", least=0, most=1), rising("recall", "hit_rate"))),
    "profile": (required("latency", "strata"), each("strata", *_LATENCY), adds_up("latency.n", "strata", "n")),
    "slices": (required("source.sha256", "source.rows", "columns"), digests("source.sha256"), counts("source.rows"), each("columns", required("labeling_method", "description"))),
    "protocol": (
        required("roles.train", "roles.tuning", "roles.calibration", "roles.final_holdout", "split.seed"), distinct(*[f"roles.{r}.sha256" for r in ("train", "tuning", "calibration", "final_holdout")]),
        each("roles", digests("sha256"), numbers("fraction", least=0, most=1)),
    ),
}


def problems(kind: str, document: dict) -> list[str]:
    """What is wrong with a document of a kind; an empty list if nothing is."""
    if kind not in RULES:
        raise ValueError(f"unknown kind of document {kind!r}; known: {', '.join(sorted(RULES))}")
    return [message for rule in RULES[kind] for message in rule(document)]


def binding_problems(report: dict, protocol: dict, role: str = "final_holdout") -> list[str]:
    """Whether a report was made on the rows of a protocol's role: its digest, its number of rows, and no other role's digest."""
    wanted = at(protocol, f"roles.{role}") or {}
    others = {n: r.get("sha256") for n, r in (at(protocol, "roles") or {}).items() if n != role}
    found = []
    if not wanted.get("sha256") or report.get("data") != wanted["sha256"]:
        found.append(f"the report's rows aren't those of {role}")
    if at(report, "metrics.n") is not None and wanted.get("n_rows") is not None and at(report, "metrics.n") != wanted["n_rows"]:
        found.append(f"the report has {at(report, 'metrics.n')} rows, {role} {wanted['n_rows']}")
    return found + [f"the report's rows are those of {n}" for n, d in sorted(others.items()) if d and d == report.get("data")]


def differences(a, b, tolerance: float = 1e-3, path: str = "") -> list[str]:
    """Where two JSON values differ; numbers may differ by the tolerance, relative or absolute."""
    if isinstance(a, dict) and isinstance(b, dict):
        lost = [f"{path}.{k} stands on one side only" for k in sorted(set(a) ^ set(b))]
        return lost + [x for k in sorted(set(a) & set(b)) for x in differences(a[k], b[k], tolerance, f"{path}.{k}")]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [x for i, (u, v) in enumerate(zip(a, b, strict=True)) for x in differences(u, v, tolerance, f"{path}.{i}")]
    if is_number(a) and is_number(b):
        return [] if math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance) else [f"{path}: {a} and {b}"]
    return [] if a == b else [f"{path}: {a!r} and {b!r}"]


def light_command(argv: Sequence[str], path_flags: Sequence[str]) -> list[str]:
    """A command line in which the values of path flags are only file names."""
    out: list[str] = []
    for i, word in enumerate(argv):
        flag, _, value = word.partition("=")
        if value and flag in path_flags:
            out.append(f"{flag}=<{value.rstrip('/').rsplit('/', 1)[-1]}>")
        elif i and argv[i - 1] in path_flags:
            out.append(f"<{word.rstrip('/').rsplit('/', 1)[-1]}>")
        else:
            out.append(word)
    return out


def commit(folder: str = ".") -> str | None:
    """The commit of a working copy, or None."""
    try:
        found = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return found.stdout.strip() or None if found.returncode == 0 else None
