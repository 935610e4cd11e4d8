"""The batched translator: each distinct piece is sent once, failures fall back, texts come back in order."""
import os
import uuid

from framelens.operators.translate import translate_texts
from framelens.schema import TRANSLATE_CAP
from framelens.sources.snapshots import Snapshots

LONG = "".join(chr(97 + k % 26) for k in range(2 * TRANSLATE_CAP + 7))
ROWS = [(1, "fr", "bonjour"), (2, "fr", "bonjour"), (2, "fr", "bonjour"), (3, "de", "bonjour"), (4, "en", "hello"), (5, "fr", None),
        (6, "fr", ""), (7, None, "quoi"), (8, "de", LONG), (None, "fr", "mal"), (9, "fr", "salut\nmal")]


def recording(folder, bad=()):
    os.makedirs(folder, exist_ok=True)

    def translator(pieces, lang):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("\0".join(f"{lang}:{p}" for p in pieces))
        if any(p in bad for p in pieces):
            raise TimeoutError
        return [f"[{p.upper()}]" for p in pieces]
    return translator


def sent(folder):
    return [p for f in os.listdir(folder) for p in open(os.path.join(folder, f), newline="").read().split("\0")]


def test_pieces_are_sent_once(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, lang string, text string")
    memo = Snapshots(spark, str(tmp_path / "memo"))
    got = translate_texts(df, recording(str(tmp_path / "one")), memo).collect()
    want = {"fr:bonjour", "de:bonjour", ":quoi", "fr:mal", "fr:salut\nmal"} | {f"de:{LONG[k:k + TRANSLATE_CAP]}" for k in range(0, len(LONG), TRANSLATE_CAP)}
    assert sorted(sent(tmp_path / "one")) == sorted(want)
    assert len(got) == len(ROWS) and all(r.n_failed == 0 for r in got)
    by = {r.id: r.text for r in got}
    assert by[2] == "[BONJOUR]" and by[4] == "hello" and by[5] is None and by[6] == "" and by[7] == "[QUOI]" and by[None] == "[MAL]"
    assert by[8] == "".join(f"[{LONG[k:k + TRANSLATE_CAP].upper()}]" for k in range(0, len(LONG), TRANSLATE_CAP))
    # the next day only what is new
    more = df.unionByName(spark.createDataFrame([(10, "fr", "demain")], df.schema))
    again = translate_texts(more, recording(str(tmp_path / "two")), memo).collect()
    assert sent(tmp_path / "two") == ["fr:demain"]
    assert sorted((r.id or 0, r.text or "") for r in again if r.id != 10) == sorted((r.id or 0, r.text or "") for r in got)


def test_failed_pieces_fall_back_and_are_tried_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "fr", "oui"), (2, "fr", "mal"), (3, "de", LONG)], "id long, lang string, text string").coalesce(1)
    memo = Snapshots(spark, str(tmp_path / "memo"))
    bad = ("mal", LONG[TRANSLATE_CAP:2 * TRANSLATE_CAP])
    got = {r.id: r for r in translate_texts(df, recording(str(tmp_path / "a"), bad), memo).collect()}
    assert got[1].text == "[OUI]" and (got[2].text, got[2].n_failed) == ("mal", 1)
    assert got[3].n_failed == 1 and bad[1] in got[3].text and got[3].text.startswith("[ABC")
    assert sent(tmp_path / "a").count("fr:mal") >= 3
    got = {r.id: r for r in translate_texts(df, recording(str(tmp_path / "b")), memo).collect()}
    assert sorted(sent(tmp_path / "b")) == sorted(["fr:mal", f"de:{bad[1]}"])
    assert got[2].text == "[MAL]" and all(r.n_failed == 0 for r in got.values())
    assert translate_texts(df.limit(0), recording(str(tmp_path / "c")), memo).count() == 0
