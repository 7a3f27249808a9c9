"""Plain versions of the document operators, for small frames."""

import hashlib
import re

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def secret_spans(text):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, rx, g, least) in enumerate(KINDS)
             for m in rx.finditer(text or "") if len(m[g]) >= least]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def secrets(rows):
    out = []
    for doc_id, text in rows:
        found = secret_spans(text)
        spans = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        n = [sum(k == kind for k, _, _ in found) for kind, *_ in KINDS]
        out.append((doc_id, *n, sha(spans), spans))
    return sorted(out, key=str)
