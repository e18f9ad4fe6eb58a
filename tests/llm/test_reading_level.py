import random

from refloom.llm import reading_level as R

CUES = {
    1: ["I see a dog.", "Come here!", "You have a cup.", "It is so big!"],
    2: ["Did you call Ruth about the ticket?", "I left the wallet at the station last Friday.", "Nobody walks to the hotel on a weekend."],
    3: ["The committee published a report that explained the decision.", "Historians agree that the settlement changed.", "Although the council had promised to protect it, most residents left."],
    4: ["Any longitudinal meta-analysis conflates the phenomenological dimensions.", "The incommensurable ramifications necessitate recalibration.", "The ostensibly anisotropic correspondence presupposes validity."],
}
SOUND = ["[door creaks]", "(sighs)", "♪ soft music ♪", "*footsteps*", "www.site.example", "Synced and corrected by Team", "-= Me presents =-", "Watch free at site dot example", "R i p p e d  b y  Me"]


def doc(rng, level, n=12):
    cues = [rng.choice(CUES[level]) if rng.random() < 0.8 else rng.choice(CUES[min(4, max(1, level + rng.choice((-1, 1))))]) for _ in range(n)] + rng.sample(SOUND, 2)
    rng.shuffle(cues)
    return "\n\n".join(f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i + 1:02d},000\n{c}" for i, c in enumerate(cues))


def test_spoken_text():
    text = "\ufeff1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>MARA: Good {\\an8}dog!</i>\r\n[barks]\r\n\r\n2\r\n00:00:03.000 --> 00:00:04.000\r\n- 42\r\n\r\n{10}{20}More|text\r\n3\r\n00:00:05,0 --> 00:00:06,0\r\nhttps://x.example/subs"
    assert R.spoken(text).split("\n") == ["Good dog!", "More|text"]
    assert R.spoken(None) == R.spoken("") == R.spoken(" \n\t") == ""
    assert R.spoken("\n\n".join(f"{i}\n00:00:01,000 --> 00:00:02,000\n{s}" for i, s in enumerate(SOUND))) == ""


def test_levels_on_held_out_documents(spark):
    rng = random.Random(7)
    truth = {i: rng.randint(1, 4) for i in range(600)}
    rows = [(i, doc(rng, t)) for i, t in truth.items()] + [(900, None), (901, ""), (902, "1\n00:00:01,000 --> 00:00:02,000\n[x]"), (903, doc(rng, 1, 4000)), (904, "Hola")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS lang", "1 AS n")
    labels = [(i, i, r, truth[i] if rng.random() < 0.95 else max(1, truth[i] - 1)) for i in range(0, 600, 4) for r in ("a", "b")] + [(9998, 3, "a", None), (9999, 4, "a", truth[4])]
    labels = spark.createDataFrame(labels, "label_id long, doc_id long, rater string, level int")
    got = {r["doc_id"]: r["level"] for r in R.estimate(docs, labels).collect()}
    assert set(got) == set(truth) | {903, 904}
    held = [i for i in truth if i % 4]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.9
    assert got[903] == 1 and set(got.values()) <= {1, 2, 3, 4}
    # Rare words give the same levels by joins as frequent ones by number.
    joined = {r["doc_id"]: r["difficulty"] for r in R.estimate(docs, labels, rounds=2, head=30).collect()}
    by_number = {r["doc_id"]: r["difficulty"] for r in R.estimate(docs, labels, rounds=2).collect()}
    assert set(joined) == set(by_number) and all(abs(joined[i] - by_number[i]) < 1e-6 for i in joined)
    assert R.estimate(docs.unionByName(docs.limit(1)), labels).count() == len(got) + 1
    assert R.estimate(docs.limit(0), labels).count() == 0
    assert R.estimate(docs, labels.limit(0)).count() == len(got)
