import numpy as np
import pytest

from millrace.llm.reading import fit_cuts, passages, reading_grades, reading_levels, syllables


COUNTED = {
    "en": "team 1 table 2 makes 1 paper 2 architecture 4 interoperability 8 helped 1 wanted 2 releases 3 the 1 created 3 creature 2 creative 3 being 2 idea 3 area 3 real 1 reality 4 react 2 reading 2 science 2 client 2 quiet 2 "
    "society 4 poem 2 people 2 nation 2 million 2 serious 3 social 2 special 2 various 3 usual 3 actual 3 value 2 fuel 2 cruel 2 studying 3 going 2 carrier 3 happiest 3 organism 4 mechanism 4 rule 1 rules 1 tables 2 boxes 2 "
    "changes 2 judges 2 watches 2 loved 1 needed 2 movement 2 lonely 2 careful 2 homes 1 documentation 5 heterogeneity 7 responsibility 6 comprehensive 4 environment 4 implementation 5 organizational 6 necessitates 4 audience 3 "
    "appliance 3 marriage 2 region 2 religion 3 period 3 radio 3 video 3 piece 1 field 1 friend 1 question 2 quality 3 language 2 queue 1 eye 1 apple 2 system 2 cooperate 4 variable 4 configuration 5 dependency 4 repository 5 database 3",
    "de": "Freigabe 3 Bibliothek 4 heute 2 Schnittstelle 3 Museum 3 aktuell 3 Region 3 Nation 3 Qualität 3 Quelle 2 beenden 3 Beet 1 beeinflussen 4 Bauer 2 neue 2 reagieren 4 Ruine 3 System 2 Haus 1 die 1 Theorie 3 Verantwortung 4 "
    "Veröffentlichung 5 Zusammenarbeit 5 speziell 3 Entwicklungsumgebung 6 Europa 3 Idee 2",
    "es": "caja 2 infraestructura 6 día 2 aunque 2 teatro 3 leer 2 poeta 3 ciudad 2 construir 2 rey 1 muy 1 Uruguay 3 bueyes 2 oído 3 ahora 3 que 1 guerra 2 guitarra 3 agua 2 lingüística 4 país 2 aire 2 causa 2 aéreo 4 idea 3 héroe 3 "
    "viuda 2 documentación 5 interoperabilidad 8 y 1 cuidado 3 cuota 2 también 2 río 2 leía 3 averiguáis 4",
}


@pytest.mark.parametrize("lang", COUNTED)
def test_syllables(lang):
    words = COUNTED[lang].split()
    assert {w: syllables(w, lang) for w in words[::2]} == {w: int(n) for w, n in zip(words[::2], words[1::2])}


def test_languages_without_rules_are_refused_and_graded_without_syllables(spark):
    with pytest.raises(ValueError):
        syllables("château", "fr")
    french = "Le chat est sur la table et le chien est dans la maison avec les enfants. " * 12
    got = reading_grades(spark.createDataFrame([(1, french)], "d long, t string"), "d", "t").first()
    assert got["lang"] == "fr" and got["sentences"] == 12 and abs(got["grade"] - ((15 + 100 * 1 / 15 - 8) / 4 + 4.4) / 2) < 0.6


def test_only_prose_is_kept():
    text = (
        "# Head\n> name | Infra | C 64\n\nFirst line\r\n    goes on. See [docs](http://x.example/a) now.\n\n| a | b |\n| --- | --- |\n\n```\ncode();\n```\n"
        "- item one\n2. item two\n\n    indented code\n\nTitle\n=====\nhttps://x.example only\n<p>Para <b>bold</b></p><pre>x = 1</pre>\n"
    )
    assert passages(text) == ["First line goes on. See   now.", "item one", "item two", "only Para bold"]


EASY = "The cat sat on the mat. The dog ran to the box. A man got the bag. "
HARD = "Notwithstanding organizational heterogeneity, the architectural interoperability necessitates comprehensive documentation across environments, insofar as the implementation disambiguates every responsibility. "
GERMAN = "Der Hund und die Katze sind nicht in dem Haus, aber das Kind ist auf der Bank. "


def docs(spark):
    rows = [
        (1, EASY * 20, "x"), (2, HARD * 12, "x"), (3, None, "x"), (4, "", "x"), (5, "short text.", "x"), (6, GERMAN * 10 + "\n\n" + HARD * 2, "x"),
        (7, "```\n" + "code " * 80 + "\n```", "x"), (8, EASY * 4000, "x"), (1, EASY * 20, "x"), (None, EASY * 20, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_grades(spark):
    got = {r["doc"]: r for r in reading_grades(docs(spark), "doc_id", "text").collect()}
    assert set(got) == {1, 2, 6, 7, 8}
    assert got[1]["grade"] < 4 and got[2]["grade"] > 14 and abs(got[1]["grade"] - got[8]["grade"]) < 0.01
    assert got[1]["sentences"] == 60 and got[1]["lang"] == "en"
    assert got[6]["lang"] == "de" and got[6]["sentences"] == 10
    assert got[7]["words"] == 0 and got[7]["grade"] == 0


def test_levels_with_and_without_ratings(spark):
    none = spark.createDataFrame([], "doc_id long, level int")
    got = [(r["doc"], r["level"]) for r in reading_levels(docs(spark), "doc_id", "text", none, "doc_id", "level").collect()]
    assert sorted(got).count((1, 1)) == 2 and (2, 5) in got
    some = spark.createDataFrame([(1, 2), (1, 2), (2, 4), (2, None), (99, 1), (8, 77), (None, 3)], "doc_id long, level int")
    got = dict((r["doc"], r["level"]) for r in reading_levels(docs(spark), "doc_id", "text", some, "doc_id", "level").collect())
    assert got[1] == 2 and got[2] >= 4
    assert reading_levels(docs(spark).limit(0), "doc_id", "text", some, "doc_id", "level").count() == 0


def test_cuts_are_where_ratings_part():
    g, lv = np.array([1.0, 2, 3, 10, 11, 20]), np.array([1, 1, 1, 2, 2, 3])
    assert fit_cuts(g, lv, 3).tolist() == [6.5, 15.5]


def test_held_out_ratings(spark):
    """Fitted on half of the raters' documents, the levels of the other half agree."""
    root = "/root/testdata/sf0.1"
    d, r = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/reading_label.parquet")
    got = reading_levels(d, "doc_id", "text", r.where("doc_id % 2 = 0"), "doc_id", "level").selectExpr("doc as doc_id", "level as ours")
    out = got.join(r.where("doc_id % 2 = 1 and level is not null"), "doc_id").selectExpr("avg(cast(ours = level as int))", "avg(cast(abs(ours - level) <= 1 as int))").first()
    assert out[0] > 0.85 and out[1] > 0.98


def test_few_ratings_lean_on_the_shares_of_levels():
    """A language with three ratings gets cuts in the gaps of its grades where the shares say; many ratings overrule them."""
    knots = np.concatenate([np.linspace(0, 1, 40), np.linspace(4, 5, 40), np.linspace(9, 10, 20)])
    shares = np.array([0.4, 0.8])
    few = fit_cuts(np.array([0.5, 4.5, 0.2]), np.array([1.0, 2.0, 2.0]), 3, knots, shares)
    assert 1 < few[0] < 4 and 5 < few[1] < 9
    many = fit_cuts(np.repeat([0.5, 4.5, 9.5], 100), np.repeat([1.0, 1.0, 3.0], 100), 3, knots, shares)
    assert 4.5 < many[0] < 9
