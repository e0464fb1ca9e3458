"""A plain sequential model of one-at-a-time ingest, to compare the batch jobs with."""

import hashlib
import json

FIELDS = {
    "model": "model",
    "usage.input_tokens": "input_tokens",
    "usage.output_tokens": "output_tokens",
    "cost.amount_usd": "cost",
    "actor.raw_user_id": "user",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def canon(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def at(doc, path):
    for part in path.split("."):
        if not isinstance(doc, dict):
            return None
        doc = doc.get(part)
    return doc


PLACES = {
    "openai": ("id", "created", "model", "user", "usage.prompt_tokens", "usage.completion_tokens", "cost.amount_usd"),
    "anthropic": (
        "id", "created_at", "model", "metadata.user_id", "usage.input_tokens", "usage.output_tokens", "cost_usd",
    ),
    "cursor": ("request_id", "timestamp", "model", "user.id", "tokens.in", "tokens.out", "billing.usd"),
}


def parse(provider, doc):
    """Canonical fields; the test payloads carry no clock, so all happen at the epoch."""
    pid, _, model, user, tin, tout, cost = (at(doc, p) for p in PLACES[provider])
    if model is not None and not isinstance(model, str):
        return None
    content = sha(canon(doc if pid is None else pid))
    if pid:
        key = sha(f"{provider}|{pid}")
    else:
        key = sha("|".join([provider, "1970-01-01T00:00:00.000Z", model or "", user or "", content]))
    return {"key": key, "model": model, "user": user, "input_tokens": tin, "output_tokens": tout, "cost": cost}


def leaf_paths(doc):
    """Paths from the root to everything that holds nothing further, one step a turn."""
    ends, ahead = [], [("", doc)]
    while ahead:
        path, node = ahead.pop()
        if node and isinstance(node, dict):
            ahead += [(f"{path}.{name}" if path else name, below) for name, below in node.items()]
        elif isinstance(node, list):
            ahead += [(path + "[]", item) for item in node]
            ends += [] if node else [path + "[]"]
        else:
            ends.append(path)
    return ends


def shape(doc):
    return "\n".join(sorted(set(leaf_paths(doc))))


class Model:
    def __init__(self, limits):
        self.limits = limits
        self.corpus = {}  # content hash -> (provider, shape, seq)
        self.events = {}  # key -> dict
        self.alerts = []
        self.results = []

    def ingest(self, seq, provider, doc):
        ev = parse(provider, doc)
        if ev is None:
            return
        known = {s for p, s, _ in self.corpus.values() if p == provider}
        digest, fp = sha(canon(doc)), shape(doc)
        self.corpus.setdefault(digest, (provider, fp, seq))
        old = self.events.get(ev["key"])
        if old is None:
            self.events[ev["key"]] = {**ev, "provider": provider, "revision": 1, "first": seq}
        else:
            changed = False
            for c in ("input_tokens", "output_tokens", "cost"):
                if ev[c] is not None and ev[c] != old[c]:
                    old[c], changed = ev[c], True
            old["revision"] += changed
        self.results.append((seq, old is None, self.events[ev["key"]]["revision"]))
        self.events[ev["key"]]["raw"] = digest
        if known and fp not in known and (provider, fp) not in {(a[1], a[3]) for a in self.alerts}:
            paths = {p for s in known for p in s.split("\n")}
            now = set(leaf_paths(doc))
            self.alerts.append((seq, provider, None, fp, tuple(sorted(now - paths)), tuple(sorted(paths - now))))
        self.silent(seq, provider)

    def silent(self, seq, provider):
        lim = self.limits
        rows = sorted((e for e in self.events.values() if e["provider"] == provider), key=lambda e: -e["first"])
        recent, base = rows[: lim.recent_window], rows[lim.recent_window :]
        if len(base) < lim.min_overall or len(recent) < lim.min_recent:
            return
        for field, column in FIELDS.items():
            high = sum(e[column] is not None for e in base) / len(base)
            low = sum(e[column] is not None for e in recent) / len(recent)
            if high >= lim.high_rate and low <= lim.low_rate:
                if (provider, field) not in {(a[1], a[2]) for a in self.alerts}:
                    self.alerts.append((seq, provider, field, None, None, None))
