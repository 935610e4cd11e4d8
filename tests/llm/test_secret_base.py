"""The fixed formats of the secret scan against a scanner written from the contract, character by character."""
import hashlib
import random
import string

import duckdb

from framelens.llm import queries, secretscan
from tests.conftest import SF_SMALL

UPPER, VALUE = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/_.=-"
WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]


def run_end(text, at, allowed):
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def assign_at(text, at):
    """(start of value, end) of an assignment that begins here, or None."""
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text[at:at + 8])
    for w in WORDS:
        if not low.startswith(w):
            continue
        k = at + len(w)
        k += text[k:k + 1] in ('"', "'") and k < len(text)
        k = run_end(text, k, " ")
        if k >= len(text) or text[k] not in ":=":
            continue
        k = run_end(text, k + 1, " ")
        k += text[k:k + 1] in ('"', "'") and k < len(text)
        end = run_end(text, k, VALUE)
        if end > k:
            return k, end
    return None


def plain_spans(text):
    found, at = [], 0
    while at < len(text):
        m = assign_at(text, at)
        if m and m[1] - m[0] >= 8:
            found.append((at, 0, "assign", m[1]))
        at = m[1] if m else at + 1
    at = 0
    while at < len(text):
        end = run_end(text, at + 4, UPPER) if text.startswith("AKIA", at) else 0
        if end > at + 4:
            if end - at >= 16:
                found.append((at, 1, "access", end))
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run_end(text, at, "0123456789abcdef")
        if end - at >= 32:
            found.append((at, 2, "hex", end))
        at = max(end, at + 1)
    return [(k, a, b) for a, _, k, b in sorted(found)]


def plain_digest(text):
    spans = plain_spans(text or "")
    n = [sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")]
    return (*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())


def test_base_spans_of_made_up_texts():
    rng = random.Random(5)
    parts = [*WORDS, "PassWord", "API_KEY", "toKEN", "ſecret", "toKen", "AKIA", "AKI", "AAKIA", "=", ":", "==", " ", "  ", "\t", '"', "'", "é", "0123456789abcdef",
             "deadbeef", "ABCDEFGH", "Z9", "x", ".", "-", "/", "\n", "𝒳", "passpassword", "abcdefgh"]
    hits = 0
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        want = plain_spans(text)
        hits += len(want)
        assert secretscan.in_order(secretscan.base_spans(text)) == want, text
    assert hits > 1_000  # enough of them to mean something


def test_query_against_the_plain_scanner(spark):
    docs = duckdb.connect().execute(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.op8_secrets(spark, SF_SMALL).collect()}
    assert got == {i: plain_digest(t) for i, t in docs}


KEYS = {"hex": lambda r: "".join(r.choices("0123456789abcdef", k=40)),
        "github": lambda r: "ghp_" + "".join(r.choices(string.ascii_letters + string.digits, k=36)),
        "stripe": lambda r: "sk_live_" + "".join(r.choices(string.ascii_letters + string.digits, k=24)),
        "access": lambda r: "AKIA" + "".join(r.choices(UPPER, k=16)),
        "base64": lambda r: "".join(r.choices(string.ascii_letters + string.digits + "+/", k=40))}


def test_formats_keep_prefixes_and_lengths():
    r = random.Random(11)
    ordinary = ["".join(r.choices(string.ascii_lowercase, k=r.randint(8, 16))) for _ in range(500)]
    labelled = {"access": [KEYS["access"](r) for _ in range(400)],
                "assign": [KEYS[k](r) for k in ("hex", "github", "stripe", "base64") for _ in range(100)]}
    f = secretscan.Formats(labelled, ordinary)
    assert {p for _, _, p, _, _ in f.kinds} >= {"AKIA", "ghp_", "sk_live_", ""}
    assert all(model.states() > 1 for model, *_ in f.kinds)
    for name, make in KEYS.items():
        assert sum(f.accepts(make(r)) for _ in range(300)) >= 270, name
    bad = ["".join(r.choices(string.ascii_uppercase, k=n)) for n in (12, 30, 60) for _ in range(100)]
    bad += ["".join(r.choices("0123456789abcdef", k=n)) for n in (24, 64) for _ in range(100)] + ordinary
    assert sum(map(f.accepts, bad)) <= 5


def test_formats_that_are_plain_words_are_left_out():
    r = random.Random(12)
    words = ["".join(r.choices(string.ascii_lowercase, k=r.randint(8, 12))) for _ in range(600)]
    f = secretscan.Formats({"assign": words[:300]}, words[300:])
    assert f.kinds == [] and not any(map(f.accepts, words))
    assert secretscan.Formats({"assign": []}, []).spans("somewhere " * 5, []) == []


def test_keys_without_a_name_are_found(spark):
    """Half of the documents name their keys and are learned from; in the others the same formats stand bare."""
    r, kinds = random.Random(13), ("github", "stripe")
    named = [(k, f"set token={KEYS[kinds[k % 2]](r)} for the internationalisation of Chapter12 pages") for k in range(400)]
    bare, rows = {}, []
    for k in range(400, 800):
        key = KEYS[kinds[k % 2]](r)
        rows.append((k, f"somebody wrote {key} in the documentation."))
        bare[k] = f"learned:15:{15 + len(key)}"
    docs = spark.createDataFrame(named + rows + [(900, None), (901, ""), (902, "z" * 300_000)], "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.spans for x in secretscan.digest(secretscan.scan(docs, secretscan.learn(docs))).collect()}
    assert sum(got[k] == span for k, span in bare.items()) >= 360
    assert all("learned" not in got[k] for k, _ in named) and got[900] == got[901] == got[902] == ""
    half = secretscan.learn(docs.where("doc_id < 200"))
    recall = {x.kind: (x.credentials, x.found) for x in secretscan.learned_recall(docs.where("doc_id between 200 and 399"), half).collect()}
    assert recall["assign"][0] == 200 and recall["assign"][1] >= 180 and recall["access"] == (0, 0)
