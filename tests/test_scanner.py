import re
from collections import Counter

import duckdb
import pytest

from cinderfold import plans
from cinderfold.operators import scanner

catalogue = plans.load()

CODE = """el.innerHTML = user;
  a.innerHTML='<b>'; b.INNERHTML = x; c.innerHTML="<i>"
d.innerHTML = '<p>'
// e.innerHTML = y
document.write (z)
password = "abcdefghij"; DEBUG = True
subprocess.run(c, shell=True)
open("../" + input)"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("code"))
    rows = [(i, code) for i, code in enumerate([CODE, "x.innerHTML=a", "x.innerHTML='<a>'", "", None, "no code"])]
    spark.createDataFrame([(i, t, "en", "code", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return out, rows


def by_re(rows):
    lines = [(i, line) for i, t in rows for line in (t or "").split("\n") if not re.match(r"\s*(//|#|\*)", line)]
    out = Counter()
    for i, line in lines:
        for n, (_, _, p) in enumerate(scanner.RULES):
            out[i, n] += len(re.findall(p, line, re.IGNORECASE))
    return +out


def test_counts_of_all_rules(spark, tables):
    path, rows = tables
    expected = by_re(rows)
    assert expected[0, 4] and expected[1, 4] and not expected[2, 4]
    assert {(r.doc_id, r.rule_id): r.n_hits for r in catalogue.QUERIES["code_scan_counts"](spark, path).collect()} == expected
    assert Counter((r.doc_id, r.rule_id) for r in catalogue.QUERIES["code_scan_findings"](spark, path).collect()) == expected


def test_severities_of_all_rules(spark, tables):
    path, rows = tables
    expected = Counter()
    for (_, n), hits in by_re(rows).items():
        expected[scanner.RULES[n][1]] += hits
    assert {r.severity: r.n for r in catalogue.QUERIES["severity_breakdown"](spark, path).collect()} == expected


def test_sql_has_all_rules(spark, tables):
    path, rows = tables
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    got = {(i, n): hits for i, n, _, _, hits in con.execute(catalogue.ORACLE_SQL["code_scan_counts"]).fetchall()}
    assert got == by_re(rows)


def test_places(spark, tables):
    path, rows = tables
    expected = Counter()
    for i, t in rows:
        for line, code in enumerate((t or "").split("\n"), 1):
            for n, (category, severity, p) in enumerate(scanner.RULES) if not re.match(r"\s*(//|#|\*)", code) else ():
                expected.update((i, n, line, m.start() + 1, category, severity, scanner.MESSAGES[n], code.strip()) for m in re.finditer(p, code, re.IGNORECASE))
    assert expected[0, 4, 2, 24, "Cross-Site Scripting (XSS)", "HIGH", scanner.MESSAGES[4], CODE.split("\n")[1].strip()] == 1
    assert Counter(map(tuple, catalogue.QUERIES["code_scan_findings"](spark, path).collect())) == expected
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    assert Counter(con.execute(f"select doc_id, rule_id, line, \"column\", category, severity, description, code from ({catalogue.ORACLE_SQL['code_scan_findings']})").fetchall()) == expected


LINES = [
    ["exec(a + req)", "x = EXECUTE b + user"], ["f'SELECT {a}'"], [".FORMAT(x) DELETE"], ["query(`${a}"], ["innerHTML = x"], ["document.write("], ["dangerouslySetInnerHTML"], [".html( user"],
    ["spawn(a + input)", "system(x + params", "popen(+req", "exec(+user"], ["child_process.x exec(`"], ["os.system(argv"], ["subprocess.run(a, shell=True"],
    [f"{w}='12345678'" for w in ("password", "passwd", "secret", "api_key", "apikey", "token", "auth")], ["AWS_SECRET", "PRIVATE_KEY", "-----BEGIN EC PRIVATE KEY"], ["verify=False", "ssl = False", "TLS=false"],
    ["CORS( * )", "Access-Control-Allow-Origin: *"], ["debug = true"], ["readFile(req", "readFileSync(req", "open(user", "fopen(query"], ["../", "..\\", "..%2F", "..%2f"],
]


def test_every_rule_has_what_it_needs(spark):
    rows = [(f"{n}-{i}", line) for n, own in enumerate(LINES) for i, line in enumerate(own)]
    got = {(r.id, r.rule_id) for r in scanner.rule_counts(spark.createDataFrame([*rows, ("none", None), ("empty", "")], "id string, text string"), "id").collect()}
    assert len(LINES) == len(scanner.RULES) == len(scanner.NEEDS) == len(scanner.MESSAGES)
    assert got == {(i, n) for i, line in rows for n, (_, _, p) in enumerate(scanner.RULES) if re.search(p, line, re.IGNORECASE)} and {(i, int(i.split("-")[0])) for i, _ in rows} <= got
