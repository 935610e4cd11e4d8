"""Fingerprints of op6_simhash against XXH64 and the contract's rule written out again."""
import re

import duckdb
import xxhash

from framelens.llm import queries
from framelens.llm.simhash import fingerprint
from tests.conftest import SF_SMALL

M = (1 << 64) - 1
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261  # fixed values of XXH64


def rot(x, r):
    return (x << r | x >> (64 - r)) & M


def lane(acc, word):
    return rot((acc + word * P2) & M, 31) * P1 & M


def xxh64(data, seed):
    at, n = 0, len(data)
    if n >= 32:
        v = [(seed + P1 + P2) & M, (seed + P2) & M, seed, (seed - P1) & M]
        while at + 32 <= n:
            v = [lane(v[k], int.from_bytes(data[at + 8 * k:at + 8 * k + 8], "little")) for k in range(4)]
            at += 32
        h = sum(rot(x, r) for x, r in zip(v, (1, 7, 12, 18))) & M
        for x in v:
            h = ((h ^ lane(0, x)) * P1 + P4) & M
    else:
        h = (seed + P5) & M
    h = (h + n) & M
    while at + 8 <= n:
        h = (rot(h ^ lane(0, int.from_bytes(data[at:at + 8], "little")), 27) * P1 + P4) & M
        at += 8
    if at + 4 <= n:
        h = (rot(h ^ int.from_bytes(data[at:at + 4], "little") * P1 & M, 23) * P2 + P3) & M
        at += 4
    for c in data[at:]:
        h = rot(h ^ c * P5 & M, 11) * P1 & M
    h = (h ^ h >> 33) * P2 & M
    h = (h ^ h >> 29) * P3 & M
    return h ^ h >> 32


def by_contract(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    pieces = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxh64(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_xxh64_values():
    assert xxh64(b"", 0) == 0xEF46DB3751D8E999 and xxh64(b"a", 0) == 0xD24EC4F1A98C6E5B  # published test values
    for n in (0, 1, 3, 4, 7, 8, 31, 32, 33, 100):
        data = bytes(range(n))
        assert xxh64(data, 42) == xxhash.xxh64_intdigest(data, seed=42)


def test_fingerprint_rule():
    odd = [None, "", " \t\n\x0b", "one", "One TWO", "ÀB c d e", "a a a a a a", "x\x1cy z w", "the same the same the same the same", "É" * 50 + " b c d"]
    for text in odd:
        assert fingerprint(text) == by_contract(text), text


def test_fingerprints_of_documents(spark):
    texts = dict(duckdb.connect().execute(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall())
    got = {r.doc_id: r.fingerprint for r in queries.op6_simhash(spark, SF_SMALL).select("doc_id", "fingerprint").collect()}
    assert got == {k: f"{by_contract(t):016x}" for k, t in texts.items()}
