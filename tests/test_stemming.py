import duckdb

from engrama.functions.stemming import stems, stems_sql

#: Words and stems that the algorithm's publication lists.
LISTED = dict(
    x.split()
    for x in """abbandonata abbandon;abbandonate abbandon;abbandonati abbandon;abbandonato abbandon;abbandonava abbandon;abbandonerà abbandon;abbandoneranno abbandon;abbandonerò abbandon;abbandono abband;abbaruffato abbaruff
abbassamento abbass;abbassando abbass;abbassato abbass;abbassò abbass;abbastanza abbast;abbatté abbatt;abbattendo abbatt;abbattere abbatt;abbattersi abbatt;abbattesse abbattess;abbatteva abbatt;abbattevamo abbatt;abbattevano abbatt
abbattimento abbatt;abbattuta abbatt;abbattuti abbatt;abbattuto abbatt;abbellire abbell;pronto pront;pronunciato pronunc;pronunzia pronunz;propaga propag;propagare propag;propizio propiz;prosa pros""".replace("\n", ";").split(";")
)
#: Longer paths through the steps, worked out by hand from their rules.
WORKED = {"velocemente": "veloc", "attivamente": "attiv", "negativamente": "negat", "abilità": "abil", "comunicazione": "comun", "biologia": "biolog", "soluzione": "soluzion", "restituzioni": "restitu", "differenza": "different", "darglielo": "dargliel", "guardandoli": "guard", "vecchio": "vecc", "laghi": "lagh", "spaghi": "spag", "quieto": "quiet", "aiuola": "aiuol", "a": "a", "12": "12", "": ""}


def test_listed_stems(spark):
    words = [*LISTED, *WORKED]
    got = {r.term: r.stem for r in stems(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert {w: got[w] for w in LISTED} == LISTED
    assert {w: got[w] for w in WORKED} == WORKED


def test_both_dialects_agree(spark):
    con = duckdb.connect()
    con.sql("create table v as select distinct unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) as term from '/root/testdata/sf0.001/documents.parquet'")
    rows = con.sql("select term from v").fetchall()
    got = sorted((r.term, r.stem) for r in stems(spark.createDataFrame(rows, "term string")).collect())
    assert got == sorted(con.sql(stems_sql("v")).fetchall()) and sum(t != s for t, s in got) > 100
