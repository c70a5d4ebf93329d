"""Secret scans: fixed base patterns, and a character convolutional network in numpy over every other candidate.

A candidate is a run of 16 or more key characters, or of 12 or more behind a label; the network reads it whole, with LEFT
characters before and RIGHT behind it. Left out are only runs that one base hit covers whole; where a hit covers a part, both
are reported. It is trained on labelled findings, made by a seeded generator: credentials of many forms, with and without
digits or long hex pieces, and things that look like them (words, identifiers, dates, paths, versions, numbers, addresses of
mail, hosts and pages), in running text. The threshold is the highest one at which at least RECALL of the held-back credentials are found.

Cases: null counts as empty. Texts without candidates (every base hit of the kinds access and hex is inside one) cost one
scan. Rows are handled one by one, whole, in Arrow batches; candidates are scored together, up to WINDOW_CHARS characters, and a run of
any length in pieces that overlap, with the same score as whole.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, ship
from .textcnn import TextCnn

#: The base patterns, least lengths (of group 2 for assign, else of the match), in the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "network")

_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
LONG_RUN = 16
#: A label, as it stands before a run of fewer characters than LONG_RUN or within it.
_LABEL = re.compile(r"""(?:[:=]|\b(?:bearer|basic|credentials?|key|token|secret|password|passphrase))["']?\s{0,2}["']?\Z""", re.I)
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of the hex pattern that is long enough
LEFT, RIGHT = 24, 8
CHARS = 130
#: Characters of candidates that wait to be scored; a longer candidate is scored on its own, in pieces.
WINDOW_CHARS = 1 << 18
RECALL = 0.98
SAMPLES, EPOCHS = 4000, 7


def key_runs(text: str) -> list[re.Match]:
    """The candidates of a text."""

    def labelled(m: re.Match) -> bool:
        return "=" in m[0].rstrip("=") or _LABEL.search(text[max(0, m.start() - LEFT) : m.start()]) is not None

    return [m for m in _RUN.finditer(text) if m.end() - m.start() >= LONG_RUN or labelled(m)]


def base_spans(text: str, candidates: list[re.Match]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base hits. candidates: the key character runs, which contain all hits but those of assign."""
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if candidates:
        if "AKIA" in text:
            found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
        found += [(c.start() + m.start(), c.start() + m.end(), "hex") for c in candidates for m in _LONG_HEX.finditer(c[0])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), CHARS - 2).astype(np.int16)


def windowed(text: str, start: int, end: int) -> np.ndarray:
    """Character numbers of a candidate with its context; a number of its own stands at either border."""
    border = np.array([CHARS - 1], np.int16)
    return np.concatenate([codes(text[max(0, start - LEFT) : start]), border, codes(text[start:end]), border, codes(text[end : end + RIGHT])])


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): n findings with context."""
    rng = random.Random(seed)
    alnum = string.ascii_letters + string.digits
    hexes = "0123456789abcdef"
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    syllables = (
        "an the er on re ing tion ou ver que men to is la de st in or ich en ge os mi ka ra al be ble ly th sh wh ness ment ful over under inter com pre pro con dis trans un ist ism ity "
        "sch ung heit keit lich schaft ein aus auf durch gegen bung tz pf eu ei ie recht stadt wirt arbeit bund zeit sprach stelle haft los mal frei vor nach zu chen burg welt "
        "eau eur euse elle oire aine eux ait oi ant ence ique isme ette ale ser par sur contre entre "
        "cion dad mente ado ido ero era illo ar ir con des gua lla rro ncia bre tar dor esa ismo"
    ).split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    number = lambda a, b: str(rng.randint(a, b))
    date = lambda: f"{rng.randint(1990, 2035)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    prefixes = ("ghp_", "gho_", "sk_live_", "pk_test_", "xoxb-", "glpat-", "npm_", "hf_")
    ends = (".com", ".org", ".net", ".de", ".example.com")
    words = lambda sep, a, b: sep.join(word() for _ in range(rng.randint(a, b)))
    secret = (
        lambda: pick(alnum, 16, rng.choice((20, 64))),
        lambda: pick(alnum + "+/", 24, 80) + rng.choice(("", "=", "==")),
        lambda: rng.choice(prefixes) + pick(alnum, 20, 40),
        lambda: "eyJ" + pick(alnum + "_-", 20, 40) + "." + pick(alnum + "_-", 30, 80) + "." + pick(alnum + "_-", 20, 43),
        lambda: pick("ABCDEF0123456789", 32, 40),
        lambda: pick(alnum + "-_", 32, 48),
        lambda: pick(string.ascii_letters, 16, rng.choice((20, 40))),
        lambda: pick(rng.choice((string.ascii_lowercase, string.ascii_uppercase)), 16, rng.choice((20, 40))),
        lambda: rng.choice(prefixes) + pick(hexes, 16, 40),
        lambda: words("/", 1, 3) + "/" + pick(hexes, 16, 32) + "/" + pick(alnum, 20, 40),
    )
    secret_by_label = (lambda: words(rng.choice("-_."), 4, 6), lambda: pick(rng.choice((alnum, string.ascii_letters)), 12, 15))
    plain = (
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))) + "/" + number(1, 9999),
        lambda: "_".join(word() for _ in range(rng.randint(2, 5))) + "_" + number(1, 99),
        lambda: "-".join(word() for _ in range(rng.randint(2, 5))) + "-" + number(1, 2035),
        lambda: ".".join((word(), word(), word())) + "/" + word() + "/" + number(1, 9999) + rng.choice(("", ".html", ".jpg")),
        lambda: date() + "T" + f"{rng.randint(0, 23):02d}-{rng.randint(0, 59):02d}-{rng.randint(0, 59):02d}" + rng.choice(("Z", "", ".000")),
        lambda: date() + "_" + word() + word() + "." + rng.choice(("csv", "log", "txt", "pdf")),
        lambda: pick(string.digits, 16, 30),
        lambda: "+" + number(1, 99) + "-" + "-".join(number(100, 9999) for _ in range(4)),
        lambda: "v" + ".".join(number(0, 99) for _ in range(3)) + "-" + rng.choice(("alpha", "beta", "release", "snapshot")) + "." + number(1, 99),
        lambda: "".join(word() for _ in range(5)) + number(1, 99),
        lambda: "".join(w.title() for w in (word(), word(), word(), word())) + number(1, 9),
        lambda: rng.choice("=-_.") * rng.randint(16, 60) + number(1, 9),
        lambda: "978-" + "-".join(number(1, 99999) for _ in range(3)) + "-" + number(0, 9) + "-" + word(),
        lambda: rng.choice((word(), "mail", "www", "m")) + number(1, 99) + "." + word() + word() + rng.choice((".com", ".org", ".net", ".example.com")),
        lambda: ".".join(number(0, 255) for _ in range(4)) + "/" + number(8, 32) + "-" + ".".join(number(0, 255) for _ in range(4)),
        lambda: words("", 4, 7) + rng.choice(("", "", ".")),
        lambda: words("", 4, 7).title() + rng.choice(("", "", ".")),
        lambda: words("", 4, 7).upper() + rng.choice(("", "", ".")),
        lambda: words(rng.choice("-_./"), 2, 6) + rng.choice(("", ".", ".html", ".jpg", ".com")),
        lambda: "".join(word().title() for _ in range(rng.randint(2, 5))),
        lambda: rng.choice("=-_.") * rng.randint(16, 60),
        lambda: words("/", 1, 3) + "/" + pick(hexes, 16, 40) + rng.choice((".jpg", ".png", ".js", ".css")),
        lambda: rng.choice(("www.", "m.", "")) + words(".", 2, 3) + rng.choice(ends),
        lambda: "//" + rng.choice(("www.", "")) + words(".", 1, 2) + rng.choice(ends) + "/" + words("/", 1, 2) + rng.choice(("", "-" + word(), "/" + number(1, 9999), "_" + word() + ".html")),
        lambda: words(".", 1, 2) + "." + words("", 2, 3) + "@",
        lambda: words("", 1, 2) + number(1, 99) + rng.choice("._-") + words("", 2, 3) + "@",
    )
    plain_by_label = (lambda: words("", 2, 4), lambda: words(rng.choice("-_./"), 2, 3), lambda: word() + "-" + number(1, 99999), lambda: date() + "T" + number(10, 23))
    lead = ("key = \"", "secret: ", "Authorization: Bearer ", "token ", "export KEY=", "credential '", "auth=", "passphrase: ", "password '")
    field = ("name: ", "title: ", "author = ", "id: ", "lang=", "class=\"", "city: ", "version = ", "date: ", "file: '")
    out = []
    for i in range(n):
        label = i % 2
        by_label = rng.random() < 0.25
        makers = (secret_by_label if label else plain_by_label) if by_label else secret if label else plain
        while True:
            token = rng.choice(makers)()
            token, mail = token.rstrip("@"), token.endswith("@")
            if _RUN.fullmatch(token) and (by_label or len(token) >= LONG_RUN):
                break
        before = words(" ", 0, 6) + " "
        if by_label:
            before += rng.choice(lead if label else field)
        elif rng.random() < (0.6 if label else 0.1 if any(c.isdigit() for c in token) else 0):
            before += rng.choice(lead)
        if not label and token.endswith(ends) and not token.startswith("//") and rng.random() < 0.5:
            before += word() + "." + number(1, 99) + "@"
        if token.startswith("//"):
            before += rng.choice(("https:", "http:"))
        after = "@" + words(".", 2, 3) + rng.choice(ends) if mail else rng.choice((" ", "\n", ". ", ", ", "\" ")) + " ".join(word() for _ in range(3))
        out.append((before + token + after, len(before), len(before) + len(token), label))
    return out


class SecretModel:
    def __init__(self, samples: int = SAMPLES, recall: float = RECALL, seed: int = 3) -> None:
        found = labelled_findings(samples, seed)
        windows, labels = [windowed(t, a, b) for t, a, b, _ in found], np.array([x[3] for x in found])
        back = np.arange(len(found)) % 10 >= 8
        self.cnn = TextCnn((CHARS,), dim=12, widths=(2, 3, 5), filters=16, seed=seed)
        self.cnn.fit([np.concatenate(windows)], np.cumsum(list(map(len, windows))), labels, np.flatnonzero(~back), EPOCHS, seed=seed)
        held = self.logits([w for w, x in zip(windows, back, strict=True) if x])
        true = np.sort(held[labels[back] == 1])
        self.threshold = float(true[int((1 - recall) * len(true))])
        self.recall = float((true >= self.threshold).mean())
        self.false_rate = float((held[labels[back] == 0] >= self.threshold).mean())

    def logits(self, windows: list[np.ndarray]) -> np.ndarray:
        return self.cnn.logits([np.concatenate(windows)], np.array(list(map(len, windows)))) if windows else np.empty(0)


def scan(texts: list[str], model: SecretModel) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: the base ones, and the candidates not within one of them that the network takes."""
    out, windows, where, size = [], [], [], 0

    def judge() -> None:
        for (i, a, b), logit in zip(where, model.logits(windows), strict=True):
            if logit >= model.threshold:
                out[i].append((a, b, "network"))
        windows.clear()
        where.clear()

    for i, text in enumerate(texts):
        candidates = key_runs(text)
        base = base_spans(text, candidates)
        out.append(list(base))
        widest = 0  # end of the base hits that begin no later: a candidate within one of them ends there at most
        later = iter([*base, (len(text) + 1, 0, "")])
        ahead = next(later)
        for c in candidates:
            while ahead[0] <= c.start():
                widest, ahead = max(widest, ahead[1]), next(later)
            if c.end() > widest:
                windows.append(windowed(text, *c.span()))
                where.append((i, *c.span()))
                size += len(windows[-1])
                if size > WINDOW_CHARS:
                    judge()
                    size = 0
    judge()
    return [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) for spans in out]


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", model: SecretModel | None = None) -> DataFrame:
    """(key, spans array<struct<start, end, kind>>) of every row; code points, end exclusive."""
    shared = Sent(docs.sparkSession, model or SecretModel())
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                spans = scan([x.as_py() or "" for x in part.column(1)], shared.value)
                rows = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(span))], names=["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, spans array<struct<start:long,end:long,kind:string>>")
    return found.withColumnRenamed("key", key)


def secret_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans as text) from the spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select(key, count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


ship(__name__)
