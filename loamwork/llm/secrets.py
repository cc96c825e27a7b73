"""Secret scans: patterns find candidates, a random forest removes false positives.

Candidates are strings of known shape (keys with a fixed prefix, private key blocks, JSON web tokens, credentials in
URLs), values assigned to a name, and long strings of mixed characters. The forest sees a candidate's length, its
character transitions, dictionary coverage, entropy and classes, the words around it, and the path it was found in. It is
trained from labelled findings. There is no public table of them here, so ``labelled_findings`` makes them from a
seed: true ones by the rules that real credentials follow, false ones as scanners report them (identifiers,
digests, placeholders, words, numbers, paths). Their number is a documented bound; a caller's own can be given instead.

A scan is one pass over all whole texts without an exchange. Findings carry a digest of the secret, not the secret.

Defined cases: null or empty texts have no findings; overlapping candidates become one, the more specific kind; equal
rows give equal findings; a null path is an empty one; an empty table stays empty; other columns are carried
through redaction whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.llm.forest import Forest, grow
from loamwork.llm.shared import small_batches, tidy

#: Kinds of candidates, the more specific first. The last group of a pattern is the secret. No length has
#: an upper bound but where the format has one.
PATTERNS = [
    ("private_key", re.compile(r"(-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----(?:\s*+[A-Z][\w-]*+: [^\n]*+)*+(?:[A-Za-z0-9+/=\s\\]*+-----END (?:[A-Z]{2,10} )?PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=\\]{20,}+)*+))")),
    ("access_key", re.compile(r"\b((?:AKIA|ASIA)[A-Z0-9]{16})\b")),
    ("platform_token", re.compile(r"\b((?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|sk_(?:live|test)_\w{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}))")),
    ("web_token", re.compile(r"\b(eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})")),
    ("url_password", re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@]*+:([^\s:/@]{3,}+)@")),
    ("assigned", re.compile(r"(?i)(?<!\w)(\w++)(?<!_)[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']([^\s\"']{8,}+)[\"']")),
    ("assigned", re.compile(r"(?i)((?:api_?key|access_?key|secret(?:_?key)?|token|passw(?:or)?d|pwd|credentials?|auth))\s{0,3}[:=]\s{0,3}([^\s\"',;]{8,}+)")),
    ("opaque", re.compile(r"(?<![\w/+=.@-])([A-Za-z0-9][A-Za-z0-9_+/-]{18,}[A-Za-z0-9]={0,2})(?![\w/+=@])")),
]
#: Words that go with a secret, and words that go with its absence.
SECRET_WORDS = frozenset("key keys apikey secret secrets token tokens password passwd pwd pass passphrase credential credentials auth authorization bearer private access login signature salt cert".split())
INNOCENT_WORDS = frozenset("sha sha1 sha256 md5 hash digest checksum commit revision rev uuid guid id ids etag version example sample test dummy fake placeholder integrity blob tree file path url href src name class color lang title".split())
#: Frequent word parts of the languages at hand, for dictionary coverage, and the shortest that counts.
PARTS = frozenset(
    "able about action after again ation back base before between build change class client code color common config content control count create current data date default delete description design detail digital direct document down each edit element enable error event every example express field file final first folder form format from function general get global group hand head height hello help home image import index info input inter item join label language last layout length level line link list load local long main make manager mark master member memory menu message meta method mode model module more name native network node note number object option order over package page panel part path people place plan point post present process product profile program project property public query question read real record report request resource response result return right room root rule sample script search section select server service session setting shared short side sign simple single site size some sort source space special stack start state static status step stop store stream string style system table target task team template test text that their there thing this time title total tree type under unit update upload user value version view visit water website which while width window with word work world write year ing tion ment ness ence der die das und nicht ung lich heit que est les des pour dans avec ción mente ado para con los las".split()
)
#: Documented parameters: findings made for each class, their seed, and the score from which a candidate is a secret.
EACH, SEED, THRESHOLD = 1500, 20, 0.5
FEATURES = ("length", "entropy", "digits", "upper", "lower", "symbols", "distinct", "transitions", "switches", "coverage", "longest_run", "hex", "secret_name", "innocent_name", "secret_near", "innocent_near", "assigned", "known_shape", "test_path", "code_path", "uuid", "placeholder")
_PLACE = re.compile(r"(?i)(x{4,}|\*{3,}|\.{3,}|<[^>]*>|\$\{|\{\{|%\(|your[_-]|example|changeme|placeholder|dummy|redacted|insert|todo|123456|abcdef(?!\d))")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_NEAR = re.compile(r"[A-Za-z]+\d*")
_TEST_PATH = re.compile(r"test|spec|example|sample|mock|fixture|docs?/")
_CODE_PATH = re.compile(r"\.(py|js|ts|java|go|rb|php|c|cpp|cs|env|ya?ml|json|toml|ini|cfg|conf|sh|tf)$")
_ALPHABET = {c: k for k, c in enumerate(string.ascii_lowercase + "0")}


@cache
def _transitions() -> np.ndarray:
    """Log chances of one character class after another in words (letters; digits as one), smoothed, from PARTS."""
    count = np.full((27, 27), 0.05)
    for word in PARTS:
        for a, b in zip(word, word[1:]):
            if a in _ALPHABET and b in _ALPHABET:
                count[_ALPHABET[a], _ALPHABET[b]] += 1
    return np.log(count / count.sum(axis=1, keepdims=True))


_PARTS = re.compile("|".join(sorted(PARTS, key=lambda w: (-len(w), w))))


def _coverage(text: str) -> float:
    """Share of letters that parts of the dictionary cover, the longest first from the left."""
    return sum(map(len, _PARTS.findall(text.lower()))) / max(1, len(text))


_CLASS = {c: k for k, group in enumerate((string.digits, string.ascii_uppercase, string.ascii_lowercase)) for c in group}


def features(secret: str, kind: str, name: str, near: list[str], path: str) -> list[float]:
    """The features of a whole candidate; near: lower-case words around it."""
    n = max(1, len(secret))
    counts = Counter(secret)
    shares = [sum(v for c, v in counts.items() if test(c)) / n for test in (str.isdigit, str.isupper, str.islower)]
    p = np.fromiter(counts.values(), float, len(counts)) / n
    table = {c: (_ALPHABET.get("0" if c.isdigit() else c.lower(), -1), _CLASS.get(c, 3 if not c.isalnum() else 0 if c.isdigit() else 1 if c.isupper() else 2), ord(c)) for c in counts}
    codes, classes, chars = np.array([table[c] for c in secret] or [(-1, 3, 0)]).T
    both = (codes[1:] >= 0) & (codes[:-1] >= 0)
    steps = _transitions()[codes[:-1][both], codes[1:][both]]
    ends = np.flatnonzero(np.concatenate((chars[1:] != chars[:-1], [True])))
    own = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()))
    around = set(near)
    low_path = path.lower()
    return [
        math.log(n), float(-(p * np.log2(p)).sum()), *shares, 1 - sum(shares), len(counts) / n, float(steps.mean()) if len(steps) else 0.0,
        int((classes[1:] != classes[:-1]).sum()) / n, _coverage(secret), int(np.diff(ends, prepend=-1).max()), float(all(c in string.hexdigits for c in counts)),
        float(bool(own & SECRET_WORDS) or any(w.endswith(("key", "token", "secret", "password")) for w in own)), float(bool(own & INNOCENT_WORDS)), float(bool(around & SECRET_WORDS)), float(bool(around & INNOCENT_WORDS)),
        float(kind == "assigned"), float(kind in ("private_key", "access_key", "platform_token", "web_token", "url_password")), float(bool(_TEST_PATH.search(low_path))), float(bool(_CODE_PATH.search(low_path))),
        float(bool(_UUID.match(secret))), float(bool(_PLACE.search(secret))),
    ]


def candidates(text: str, path: str = "") -> list[tuple[int, int, str, list[float]]]:
    """(start, end, kind, features) of each candidate in order; where two overlap, the more specific kind stays."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []  # in order, apart from each other
    for kind, pattern in PATTERNS:
        g, fresh, k = pattern.groups, [], 0
        for m in pattern.finditer(text):
            a, b = m.span(g)
            while k < len(found) and found[k][1] <= a:
                k += 1
            if (k == len(found) or b <= found[k][0]) and (kind != "opaque" or _mixed(m[g])):
                fresh.append((a, b, kind, m[1] if g > 1 else ""))
        found = sorted(found + fresh)
    out = []
    for a, b, kind, name in found:
        near = [w.lower() for w in _NEAR.findall(text[max(0, a - 60) : a])[-4:] + _NEAR.findall(text[b : b + 40])[:3]]
        out.append((a, b, kind, features(text[a:b], kind, name, near, path)))
    return out


def _mixed(s: str) -> bool:
    """Whether a bare string has digits and letters in turn, as no word has."""
    return sum(map(str.isdigit, s)) >= 3 and sum(map(str.isalpha, s)) >= 3


def labelled_findings(each: int = EACH, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(text, path, label) with one candidate each: label 1 for secrets, 0 for what only looks like one."""
    r = random.Random(seed)
    letters = string.ascii_letters + string.digits
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    word = lambda: r.choice(sorted(PARTS))
    filler = lambda: " ".join(word() for _ in range(r.randint(2, 6)))
    secret_name = lambda: r.choice(["token", "api_key", "apiKey", "secret", "password", "access_key", "SECRET_KEY", "auth_token", "client_secret", "db_password", "API_TOKEN", "private_key", "credentials", "passwd"])
    plain_name = lambda: r.choice(["commit", "sha256", "id", "uuid", "checksum", "version", "name", "title", "href", "class", "etag", "digest", "file", "color", "user", "label", "rev", "build", "trace_id", "integrity"])
    value = lambda: r.choice([
        lambda: pick("0123456789abcdef", r.choice([32, 40, 64])), lambda: pick(letters, r.randint(16, 64)), lambda: pick(letters + "+/", r.choice([40, 43, 44, 64])) + r.choice(["", "="]),
        lambda: word().capitalize() + pick("!@#$%^&*", 1) + pick(string.digits, r.randint(2, 4)) + pick(letters, r.randint(4, 8)), lambda: pick(letters + "-_", r.randint(20, 50)), lambda: pick("0123456789ABCDEF", 32),
    ])()
    assign = lambda n, v: r.choice([f'{n} = "{v}"', f"{n}: '{v}'", f'"{n}": "{v}"', f"{n}='{v}'", f'{n} = "{v}";'])
    true_rules = [
        *[lambda: assign(secret_name(), value())] * 6, lambda: f"{secret_name()}={pick(letters, r.randint(16, 48))}", lambda: r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(letters, 36), lambda: "sk_live_" + pick(letters, 24), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(letters, 24), lambda: "AIza" + pick(letters + "-_", 35),
        lambda: f"eyJ{pick(letters, 30)}.eyJ{pick(letters, 60)}.{pick(letters + '-_', 43)}", lambda: f"postgres://{word()}:{pick(letters, 14)}@{word()}.example.net/db",
        lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + pick(letters + "+/", 64) + "\n" + pick(letters + "+/", 64) + "\n-----END RSA PRIVATE KEY-----", lambda: f"{r.choice(['token', 'bearer', 'api key', 'secret'])} {pick(letters, 40)}",
    ]
    false_rules = [
        *[lambda: assign(plain_name(), value())] * 3, lambda: assign(plain_name(), "-".join(word() for _ in range(r.randint(2, 5)))), lambda: assign(secret_name(), r.choice(["your_api_key_here", "changeme123", "xxxxxxxxxxxxxxxx", "<insert-token>", "${SECRET_TOKEN}", "example-token-value", "REDACTED-VALUE", "dummy_password"])),
        lambda: assign(secret_name(), "_".join(word() for _ in range(r.randint(2, 4)))), lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: assign(r.choice(["id", "uuid", "request_id"]), "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))),
        lambda: f"commit {pick('0123456789abcdef', 40)}", lambda: f"sha256:{pick('0123456789abcdef', 64)}", lambda: f"{word()}{word()}{r.randint(100, 999)}{word()}{r.randint(10, 99)}", lambda: "/".join([word(), word(), f"{word()}{r.randint(1000, 9999)}", word()]),
        lambda: pick(string.digits, 12) + word() + pick(string.digits, 8) + word(), lambda: "-".join([word(), word(), str(r.randint(1000, 9999)), word(), word()]), lambda: assign("style", f"{word()}{r.randint(100, 999)}px-{word()}"),
    ]
    paths = ["src/app.py", "config/prod.env", "tests/test_app.py", "docs/readme.md", "deploy/values.yaml", "web/index.html", "", "", "src0", "src7"]
    out = []
    for label, rules in ((1, true_rules), (0, false_rules)):
        made = 0
        while made < each:
            text, path = f"{filler()} {r.choice(rules)()} {filler()}", r.choice(paths)
            if len(candidates(text, path)) == 1:
                out.append((text, path, label))
                made += 1
    return out


@cache
def model(each: int = EACH, seed: int = SEED) -> Forest:
    return train(labelled_findings(each, seed))


def train(findings: list[tuple[str, str, int]]) -> Forest:
    """A forest from labelled findings; every candidate of a text carries its label."""
    x, y = [], []
    for text, path, label in findings:
        for *_, f in candidates(text, path):
            x.append(f)
            y.append(label)
    return grow(np.array(x), np.array(y))


def scan(text: str | None, path: str | None, forest: Forest) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of each candidate."""
    found = candidates(text or "", path or "")
    if not found:
        return []
    scores = np.concatenate([forest.scores(np.array([f for *_, f in found[k : k + 10_000]])) for k in range(0, len(found), 10_000)])
    return [(a, b, kind, float(s)) for (a, b, kind, _), s in zip(found, scores)]


def findings(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each candidate: doc_id, start, stop (code points), kind, score, is_secret and its SHA-256."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or model())  # some hundred nodes a tree

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            for doc, text, path in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for a, b, kind, s in scan(text, path, sent.value):
                    rows.append((doc, a, b, kind, s, s >= threshold, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "start", "stop", "kind", "score", "is_secret", "secret_sha256"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.col("source").cast("string") if "source" in docs.columns else F.lit("")))
    return rows.mapInArrow(tidy(run), "doc_id long, start long, stop long, kind string, score double, is_secret boolean, secret_sha256 string")


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of docs, secrets in text replaced by mark."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or model())
    at, where = docs.columns.index("text"), docs.columns.index("source") if "source" in docs.columns else None
    schema = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            paths = batch.column(where).to_pylist() if where is not None else [""] * len(texts)
            for k, (text, path) in enumerate(zip(texts, paths)):
                parts, at_end = [], 0
                for a, b, _, s in scan(text, None if path is None else str(path), sent.value):
                    if s >= threshold:
                        parts += [text[at_end:a], mark]
                        at_end = b
                if parts:
                    texts[k] = "".join([*parts, text[at_end:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return small_batches(docs).withColumn("text", F.col("text").cast("string")).mapInArrow(tidy(run), schema)
