import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions import names as N


def one(spark, expr, **values):
    cols = ", ".join(f"cast({'null' if v is None else repr(v)} as {'string' if isinstance(v, str) else 'double'}) as {k}" for k, v in values.items())
    return spark.sql(f"select {cols}").select(expr.alias("x")).first().x


def test_rates(spark):
    eff = X.efficiency("p", "a", "f")
    assert one(spark, eff, p=31, a=12, f=50) == pytest.approx(31 / 68, abs=1e-9)
    assert one(spark, eff, p=9, a=0, f=0) is None and one(spark, eff, p=0, a=3, f=0) == 0
    use = X.usage("a", "f", "t", "m", "ta", "tf", "tt", "tm")
    # one of five alike who is there all the time uses a fifth
    assert one(spark, use, a=40, f=25, t=9, m=70, ta=200, tf=125, tt=45, tm=350) == pytest.approx(0.2, abs=1e-9)
    assert one(spark, use, a=40, f=25, t=9, m=35, ta=200, tf=125, tt=45, tm=350) == pytest.approx(0.4, abs=1e-9)
    assert one(spark, use, a=40, f=25, t=9, m=0, ta=200, tf=125, tt=45, tm=350) is None and one(spark, use, a=0, f=0, t=0, m=5, ta=0, tf=0, tt=0, tm=25) is None
    assert one(spark, X.per_unit("s", "m"), s=7, m=63) == 4.0 and one(spark, X.per_unit("s", "m"), s=7, m=0) is None
    assert one(spark, X.ratio("s", "m"), s=1, m=0) is None and one(spark, X.ratio("s", "m"), s=1, m=4) == 0.25
    share = X.share_while_active("s", "w", "tw", "tm", "m")
    assert one(spark, share, s=5, w=10, tw=0, tm=9, m=1) is None
    assert one(spark, share, s=5, w=10, tw=100, tm=40, m=6) == pytest.approx(5 / (10 / 20 * 40 - 6))


def test_scores_and_shares(spark):
    assert one(spark, X.z_score("x", "m", "s"), x=3, m=1, s=0) is None and one(spark, X.z_score("x", "m", "s"), x=3, m=1, s=2) == 1.0
    for parts in ((0.2, 0.3, 0.5), (0.0, 0.0, 1.0)):
        row = spark.createDataFrame([parts], "a double, b double, c double").select(*X.log_shares(["a", "b", "c"])).first()
        assert sum(row) == pytest.approx(0, abs=1e-12) and all(abs(v) < 10 for v in row)
    assert X.normal_quantile(0.8) == pytest.approx(1.2815515655446004) and X.normal_quantile(0.95) == pytest.approx(1.959963984540054)
    assert one(spark, X.rounded("x", 2), x=2.675) == 2.68 and one(spark, X.finite(F.lit(float("nan"))), x=1) is None
    assert one(spark, X.log_weight("x"), x=0) is None


@pytest.mark.parametrize("raw,plain", [("Søren Ødegård", "Soren Odegard"), ("Wałęsa", "Walesa"), ("Đặng Thùy", "Dang Thuy"), ("Größe", "Grosse"), ("plain", "plain"), ("", "")])
def test_strip_marks(spark, raw, plain):
    assert one(spark, N.strip_marks("n"), n=raw) == plain


def test_strip_marks_of_long_texts(spark):
    """Python gets each text's different letters outside ASCII, once, and never the text; the
    result is that of the whole text."""
    raw = ["é" * 5000 + " ﬁ½ 한글 𝐀 x\u0301 Ł ß " * 300, "plain " * 4000, "\u0301", None]
    want = [None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.replace("Ł", "L").replace("ß", "ss")) if not unicodedata.combining(c)) for s in raw]
    seen = []

    def watched(letters):
        seen.append(letters)
        return told(letters)

    told, N._decomposed = N._decomposed, watched
    try:
        plain = N.strip_marks("n")
    finally:
        N._decomposed = told
    df = spark.createDataFrame(list(enumerate(raw)), "i int, n string")
    assert [r[0] for r in df.orderBy("i").select(plain).collect()] == want
    assert [r[0] for r in df.orderBy("i").select(F.coalesce(F.length(seen[0]), F.lit(0))).collect()] == [7, 0, 1, 0]


def test_strip_marks_without_python(spark):
    """No letters go through Python, which held a batch's syllables at once; every assigned character has
    the result of NFKD by character."""
    every = [c for c in map(chr, range(1, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.category(c) not in ("Cn", "Co")]
    raw = ["".join(every[i : i + 500]) for i in range(0, len(every), 500)] + ["각가힣 Zoë … ½ 😀"]
    folds = str.maketrans(N.FOLD_FROM + "ß", N.FOLD_TO + "\0")
    want = ["".join(d for d in unicodedata.normalize("NFKD", s.translate(folds).replace("\0", "ss")) if not unicodedata.combining(d)) for s in raw]
    plain = spark.createDataFrame(list(enumerate(raw)), "i int, n string").select("i", N.strip_marks("n").alias("p"))
    assert [r.p for r in plain.orderBy("i").collect()] == want
    assert "Python" not in plain._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("raw,key", [("T. S. Eliot", "ts eliot"), ("TS Eliot", "ts eliot"), ("t s eliot", "ts eliot"), ("Davis Jr.", "davis"), ("Henry Tudor VIII", "henry tudor viii"), ("Louis Capet IV", "louis capet"), ("Conan O’Brien", "conan obrien"), ("Mary-Jane  Holt", "mary jane holt"), (" ", "")])
def test_normalized(spark, raw, key):
    assert one(spark, N.normalized("n"), n=raw) == key


def test_keys_titles_periods(spark):
    assert one(spark, N.match_key("n"), n="ÅNGSTRÖM, ANDERS") == one(spark, N.match_key("n"), n="Anders Angstrom")
    assert one(spark, N.match_key("n"), n="Meyer") != one(spark, N.match_key("n"), n="Mayer")
    for raw, want in (("CURIE, MARIE", "Marie Curie"), ("D'ARC, JEANNE", "Jeanne D'Arc"), ("SAINT-SAENS, CAMILLE", "Camille Saint-Saens"), ("ADA LOVELACE", "Ada Lovelace"), ("KING, MARTIN, JR", "Martin, Jr King")):
        assert one(spark, N.first_last("n"), n=raw) == want
    assert tuple(one(spark, N.parse_period("n", ["A", "B"]), n="A_1987")) == ("A", 1987)
    # no separator, a group that is not listed, no number, a sign, blanks, nothing
    for bad in ("B1987", "Z_1987", "B_", "B_-1987", "B_19 87", "B_1987 ", "_1987", "B", "B__"):
        with pytest.raises(Exception, match="not a period id"):
            one(spark, N.parse_period("n", ["A", "B"]), n=bad)
    for first in (1890, 1909, 2008, 2098):
        assert one(spark, N.period_label(F.lit(first)), n="x") == f"{first}-{str(first + 1)[-2:]}"
