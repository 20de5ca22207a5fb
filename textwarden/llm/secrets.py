"""Secret scans: patterns propose candidates, a random forest removes false findings.

The forest's features are the candidate's length, its character transitions, how much of it dictionary words cover,
marks of its path, and the words around it. It is trained in numpy from labelled findings; without a table of such
findings it learns from labelled_findings(), which makes them by rule: secrets behind credentials' names and without any
(issuers' prefixes, bearer tokens, passwords in addresses, bare random values), and what scanners mistake for them.

Cases: null and empty texts hold no candidate; a null path has no marks; overlapping candidates keep the first pattern's;
repeated rows are scanned each; texts of any length are scanned whole; an empty table gives an empty result. Values are
returned as SHA-256 digests, never in the clear.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rule names and patterns; the value is the last group. Order decides between overlapping candidates.
RULES = [
    ("private_key", re.compile(r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)")),
    ("cloud_key", re.compile(r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b")),
    ("prefixed_token", re.compile(r"\b((?:gh[pousr]_|sk-|xox[abprs]-|glpat-)[A-Za-z0-9_-]{16,})")),
    ("web_token", re.compile(r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})")),
    ("assignment", re.compile(r"(?i)\b(?:api[_-]?key|secret|token|passwd|password|pwd|auth|access[_-]?key|credential)s?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{8,})")),
    ("url_password", re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s:/@]{6,})@")),
    ("long_string", re.compile(r"(?<![\w+/-])([A-Za-z0-9+/_-]{24,}={0,2})(?![\w+/=-])")),
]
DICTIONARY = "about access account admin after api app auth base before build cache change check class client code commit config connect content count create data date default delete demo development document dummy email error event example false field file filter first from function group handler header hello hash home host image index info input insert item key label last length license line list load local lock login main manager message model name network node null number object option order output page param parent password path placeholder point port process project query read record remote replace request response result return root sample schema secret server service session set size source start state status string system table target task template test text this time title token true type update upload user util value version view with word world write your".split()
HINTS = [["token", "secret", "password", "passwd", "api", "auth", "credential", "bearer", "login"], ["example", "sample", "dummy", "placeholder", "test", "demo", "fake", "your"], ["commit", "sha", "md5", "checksum", "hash", "digest", "etag", "revision", "integrity"], ["uuid", "guid", "id", "request", "trace", "session"], ["license", "copyright", "version", "http", "https", "www"]]
#: The words of a text, for hints.
_HINT_WORDS = re.compile(r"[a-z0-9]+")
PATHS = [["test", "spec", "fixture", "mock"], ["example", "sample", "docs", "readme"], [".env", "config", "settings", "deploy", "secret"], ["lock", "min.js", "vendor", "dist"]]
#: Beginnings that token issuers give their keys.
PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "glpat-", "AKIA", "ASIA", "eyJ", "-----BEGIN")
NEAR = 60
_WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) >= 3), key=len, reverse=True)))


def features(value: str, before: str, after: str, path: str | None) -> list[float]:
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    n = max(1, len(value))
    steps = list(zip(kinds, kinds[1:], strict=False))
    share = lambda f: sum(f(a, b) for a, b in steps) / max(1, len(steps))
    counts = {c: value.count(c) for c in set(value)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    lower = value.lower()
    covered = sum(len(m) for m in _WORDS.findall(lower)) / n
    vowels = sum(a in "aeiou" and b not in "aeiou0123456789" for a, b in zip(lower, lower[1:], strict=False)) / max(1, n - 1)
    near, of = _words(before) | _words(after), (path or "").lower()
    line = _words(before.rpartition("\n")[2])
    return [
        n, entropy, covered, vowels, max(counts.values(), default=0) / n, *(kinds.count(k) / n for k in range(4)),
        share(lambda a, b: a != b), share(lambda a, b: {a, b} == {0, 2}), share(lambda a, b: {a, b} == {0, 1}), share(lambda a, b: a == b == 2),
        float(all(c in "0123456789abcdef" for c in lower)), float(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", lower) is not None),
        float(value.startswith(PREFIXES)), *(float(any(w in near for w in hint)) for hint in HINTS), float(any(w in line for w in HINTS[0])), float(before.rstrip(" \"'").endswith(("=", ":"))), *(float(any(w in of for w in mark)) for mark in PATHS),
    ]


def _words(text: str) -> set[str]:
    """Words in lower case, plurals as their singular too."""
    found = _HINT_WORDS.findall(text.lower())
    return {*found, *(w[:-1] for w in found if w.endswith("s"))}


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, rule) in code points, without overlaps, in text order."""
    starts: list[int] = []  # of what is taken, in order
    taken: list[tuple[int, int, str]] = []
    for name, pattern in RULES:
        for m in pattern.finditer(text or ""):
            s, e = m.span(m.lastindex)
            if name == "long_string" and not (any(c.isdigit() for c in m.group(m.lastindex)) and any(c.isalpha() for c in m.group(m.lastindex))):
                continue
            at = bisect.bisect_left(starts, s)
            if (at and taken[at - 1][1] > s) or (at < len(taken) and taken[at][0] < e):
                continue
            starts.insert(at, s)
            taken.insert(at, (s, e, name))
    return taken


def labelled_findings(n: int = 5000, seed: int = 3) -> list[tuple[str, str, str, str | None, int]]:
    """(value, before, after, path, label): secrets, and what scanners mistake for them."""
    rng = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(rng.choices(alphabet, k=rng.randint(a, b)))
    words = lambda a, b: [rng.choice(DICTIONARY) for _ in range(rng.randint(a, b))]
    any_path = lambda: rng.choice([None, "src3", "src/app.py", "conf/settings.yaml", ".env", "web/main.js"])
    hexed = lambda: pick("0123456789abcdef", *[rng.choice([32, 40, 48, 64])] * 2)  # noqa: E731  as long as digests are
    random_value = lambda a, b: hexed() if b > 40 and rng.random() < 0.3 else pick(rng.choice(["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"]), a, b)
    out = []
    for _ in range(n // 2):
        lead, tail = " ".join(words(0, 6)) + rng.choice(["\n", " "]), " " + " ".join(words(0, 6))
        kind = rng.randrange(-3, 8)
        if kind < 3:  # behind a credential's name
            value = rng.choice(["", "", "", "ghp_", "sk-", "AKIA"]) + random_value(16, 64)
            name = rng.choice(["token", "secret", "api_key", "password", "auth", "access_key"])
            before = lead + rng.choice([f'{name} = "', f"{name}: ", f"{name}='", f"export {name.upper()}="])
        elif kind == 3:  # an issuer's prefix, in prose
            value, before = rng.choice(["ghp_", "sk-", "xoxb-", "glpat-"]) + pick(string.ascii_letters + string.digits, 20, 48), lead
        elif kind == 4:
            value, before = rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16, 16), lead
        elif kind == 5:
            value, before = "eyJ" + pick(string.ascii_letters + string.digits, 12, 40) + "." + pick(string.ascii_letters + string.digits + "_-", 20, 60) + "." + pick(string.ascii_letters + string.digits + "_-", 20, 43), lead + rng.choice(["", "Bearer ", "Authorization: Bearer "])
        elif kind == 6:  # a value of no name, or of one that says nothing
            value, before = pick(string.ascii_letters + string.digits + "+/", 32, 64), lead + rng.choice(["", f"{rng.choice(DICTIONARY)} = ", f"{rng.choice(DICTIONARY).upper()}="])
        else:
            value, before, tail = random_value(8, 32), lead + rng.choice(["postgres", "mysql", "https", "amqp"]) + f"://{rng.choice(DICTIONARY)}:", f"@{rng.choice(DICTIONARY)}.net/{rng.choice(DICTIONARY)}"
        out.append((value, before, tail, any_path(), 1))
        shape = rng.randrange(11)
        before, after, path = " ".join(words(2, 8)) + " ", " " + " ".join(words(2, 8)), any_path()
        if shape == 0:
            value, before = pick("0123456789abcdef", 40, 40), before + rng.choice(["commit ", "sha1 ", "revision ", "checksum: "])
        elif shape == 1:
            value, before = str(uuid.UUID(int=rng.getrandbits(128))), before + rng.choice(["request id ", "uuid=", "trace "])
        elif shape == 2:
            value, before = rng.choice(["your_api_key_here", "example_token_value", "changeme12345", "xxxxxxxxxxxxxxxx", "placeholder_secret_1", "dummy-password-0"]), before + "token = "
        elif shape == 3:
            value = rng.choice(["_", "-", "/", ""]).join(w if rng.random() < 0.6 else w.title() for w in words(3, 7)) + str(rng.randint(0, 999))
        elif shape == 4:
            value, before = "_".join(words(2, 4)) + "()", before + rng.choice(["token = ", "password: "])
        elif shape == 5:
            value, path = pick(string.ascii_letters + string.digits, 20, 40), rng.choice(["tests/fixture.py", "docs/example.md", "spec/mock.json"])
            before += "example token = "
        elif shape == 6:
            value, before = pick("0123456789abcdef", 64, 64), before + rng.choice(["sha256 digest ", "integrity hash ", "etag "])
        elif shape == 8:
            value, before = "AKIA" + pick(string.ascii_uppercase, 5, 9) + "EXAMPLE", before + rng.choice(["", "example key "])
        elif shape == 9:
            value, before, after = rng.choice(["password", "secret", "changeme", "example", "your-password"]) + rng.choice(["", "1", "123"]), before + f"postgres://{rng.choice(DICTIONARY)}:", "@localhost/test"
        elif shape == 10:
            value, before = rng.choice(["sk-", "ghp_"]) + rng.choice(["x", "0", "your-key-here-"]) * rng.randint(16, 24), before + rng.choice(["token = ", "example "])
        else:
            value, before = "/".join(words(3, 6)) + f"/{rng.randint(1, 99)}", before + "https "
        out.append((value, before, after, path, 0))
    return out


class Forest:
    """Gini trees over bootstrap samples, each split from a random set of features; kept as flat arrays."""

    def __init__(self, trees: int = 60, depth: int = 12, least: int = 3, seed: int = 1):
        self.trees, self.depth, self.least, self.rng = trees, depth, least, np.random.default_rng(seed)
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.trees):
            rows = self.rng.integers(len(x), size=len(x))
            feature, cut, child, value = [], [], [], []

            def grow(at: np.ndarray, depth: int) -> int:
                me = len(feature)
                feature.append(-1)
                cut.append(0.0)
                child.append((0, 0))
                value.append(float(y[at].mean()))
                best = self._split(x[at], y[at]) if depth and 0 < y[at].mean() < 1 and len(at) >= 2 * self.least else None
                if best:
                    feature[me], cut[me] = best
                    left = x[at, best[0]] <= best[1]
                    child[me] = grow(at[left], depth - 1), grow(at[~left], depth - 1)
                return me

            grow(rows, self.depth)
            self.nodes.append((np.array(feature), np.array(cut), np.array(child), np.array(value)))
        return self

    def _split(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        best, choice = 1e-9, None
        whole = y.mean() * (1 - y.mean()) * len(y)
        for f in self.rng.permutation(x.shape[1])[: max(1, int(math.sqrt(x.shape[1]) * 1.5))]:
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            a, b = hits[:-1], hits[-1] - hits[:-1]
            gain = whole - (a * (1 - a / n) + b * (1 - b / (len(y) - n)))
            gain[(v[1:] == v[:-1]) | (n < self.least) | (len(y) - n < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, choice = gain[k], (int(f), float((v[k] + v[k + 1]) / 2))
        return choice

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, child, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                right = (x[np.arange(len(x)), f] > cut[at]).astype(int)
                at = np.where(inner, child[at, right], at)
            out += value[at]
        return out / max(1, len(self.nodes))


def train(findings: list[tuple[str, str, str, str | None, int]] | None = None) -> Forest:
    rows = labelled_findings() if findings is None else findings
    return Forest().fit(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float))


SCHEMA = "doc_id long, start int, end int, rule string, value_sha256 string, probability double, is_secret boolean"


def scan(docs: DataFrame, forest: Forest | None = None, path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = [], []
            for doc_id, text, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s, e, rule in candidates(text):
                    rows.append((doc_id, s, e, rule, hashlib.sha256(text[s:e].encode()).hexdigest()))
                    x.append(features(text[s:e], text[max(0, s - NEAR) : s], text[e : e + NEAR], path))
            if rows:
                p = sent.value.probability(np.array(x))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array(p >= threshold)], names=["doc_id", "start", "end", "rule", "value_sha256", "probability", "is_secret"])

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("_path")).mapInArrow(run, SCHEMA)
