import random

from refloom.llm import name_variants as N

LEX = frozenset({"robert", "katherine", "aino", "mei", "kwame"})


def test_parse():
    assert N.parse("Smith, Robert J.", LEX)[:4] == ("smith", "robert", "r", "j")
    assert N.parse("Bob Smith", LEX)[:4] == ("smith", "robert", "r", "")
    assert N.parse("SMITH, ROBERT", LEX)[:4] == ("smith", "robert", "r", "")
    assert N.parse("R. J.Smith", LEX)[:4] == ("smith", "", "r", "j")
    assert N.parse("Smith RJ", LEX)[:4] == ("smith", "", "r", "j")
    assert N.parse("Derinezask Aino", LEX)[:4] == ("derinezask", "aino", "a", "")
    assert N.parse("van der Berg, K.", LEX) == ("berg", "", "k", "", "vanderberg")
    assert N.parse("Kwame d'Ål", LEX)[:2] == ("al", "kwame")
    org = N.parse("Institute of Rivers and Shores, Xyloburg")
    assert org[2] == "#" and org == N.parse("{Xyloburg Inst. of Rivers & Shores}") == N.parse("The Institute of Rivers and Shores at Xyloburg")
    for v in (None, "", "  ", "123", "{}"):
        assert N.parse(v)[0] == ""


NAMES = {
    1: ["Katherine Brown", "Brown, Kate", "K. Brown", "BROWN, Katherine M.", "Katherine Borwn", "Kahterine Brown", "Brown K", "Brown,Katherine", "Bröwn, Katherine"],
    2: ["Robert Brown", "Bob Brown", "R. Brown"],
    3: ["Mei van Gitorsosk", "vanGitorsosk, Mei", "M. van Gitorsosk"],
    4: ["Xyloburg Institute of Rivers and Shores", "Institute of Rivers and Shores, Xyloburg", "Xyloburg Inst. of Rivers and Shores", "Xyolburg Institute of Rivers and Shores"],
    5: ["Xyloburg Academy of Rivers and Shores"],
    6: ["Robert Green", "Green, Robert A."],
    7: ["Rosa Green"],
    8: ["R. Green"],
}


def table(spark):
    rows, truth = [], {}
    for g, names in NAMES.items():
        for n in names:
            truth[len(rows) + 1] = g
            rows.append((len(rows) + 1, n))
    lexicon = [f"Filler{c}{d}, {g}" for c in "abcd" for d in "xyz" for g in ("Robert", "Katherine", "Mei", "Rosa")]
    filler = [(1000 + i, n) for i, n in enumerate(lexicon)]
    random.Random(1).shuffle(rows)
    return truth, spark.createDataFrame([*rows, *filler, (5000, None), (5001, ""), (5002, "1234"), (5003, "Q" * 5000 + ", Ada")], "name_id long, name string")


def test_links(spark):
    truth, names = table(spark)
    got = {tuple(r) for r in N.variant_pairs(names.selectExpr("*", "name AS node", "name AS label")).where("name_id_a < 1000 AND name_id_b < 1000").collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert got == want
    assert N.resolve(names).where("name_id >= 5000").select("name_id").collect()[0][0] == 5003
    assert N.variant_pairs(names.limit(0)).count() == 0


def entities(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "name_id long, name string")
    out = {}
    for r in N.resolve(df).collect():
        out.setdefault(r["entity"], set()).add(names[r["name_id"]])
    return sorted(map(sorted, out.values()))


def test_people_of_one_name(spark):
    many = [f"Quill, John {a}. {b}. {c}." for a in "ABCDEFGH" for b in "ABCDEFG" for c in "ABCDEFG"]
    apart = [
        ["Smith, John A."], ["Smith, John C."], ["Smith, John"],  # the bare name may be either
        ["Doane, John A.", "Doane, John AB", "Doane, John", "Daone, John A."],
        # An error is met by the initial it bears, and the bare misspelling by what it alone can be.
        ["Brown, John A."], ["Brown, John C.", "Browne, John C.", "Browne, John"],
        ["Novak, Andy", "Novak, Andrew"], ["Roe, Andy", "Roe, Ondrej"], ["Poe, Andy"], ["Poe, Andrew"], ["Poe, Ondrej"], ["Poe, Chuck", "Charles Poe"],
        *[[n] for n in many],
    ]
    assert entities(spark, [n for g in apart for n in g]) == sorted(map(sorted, apart))


def test_a_large_lexicon_is_joined(spark):
    _, names = table(spark)
    lexicon = N.given_lexicon(names)
    rows = lambda most: sorted(map(tuple, N.parsed(names, lexicon, most).collect()), key=str)
    assert lexicon.count() > 3 and rows(0) == rows(100)


def test_sizes(spark):
    _, names = table(spark)
    got = {r["name_id"]: r["n_links"] for r in N.entity_sizes(names).collect()}
    want = {}
    for r in N.variant_pairs(names).collect():
        for i in r:
            want[i] = want.get(i, 0) + 1
    assert {i: n for i, n in got.items() if n} == want


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    nodes = spark.range(400).selectExpr("id AS node", "id AS label")
    got = {r["node"]: r["label"] for r in N.components(spark.createDataFrame(edges, "a long, b long"), nodes).collect()}
    assert got == {i: find(i) for i in range(400)}
