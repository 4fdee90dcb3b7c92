import pytest

from symbolmill.llm.syntax import fault_of, invalid_files, invalid_rates

GOOD = {
    "php": [
        "<?php\nclass A extends B implements C { use T; const X = 1; public function f(?int $a, string ...$b): ?self { return $a ?? fn($x) => $x['k']; } }\n",
        "<?php $a = <<<TXT\nIt's { not ( closed\n  TXT;\n$b = \"x {$a['k']} (\"; # it's\n#[Attr(1)]\nfunction f() { return match(true) { default => '}' }; }",
        "<?php $a = \"x {$b[\"k\"]} y {$c->d(\"{$e['f']}\")}\"; if (f($a)) $b = (int) $c; foreach (g() as $x) print(1) . 2;",
        "<p>it's ( html</p><?= $x ?> more { html <?php if ($a): ?>x<?php endif; ?>",
        "<?php // ends ?>\n<b>don't</b>",
        "<?php f();\n__halt_compiler();\n{{ [ unused don't\n",
        "<?php\n/* <<<<<<< HEAD */\n$s = '\n=======\n';\n",
        "<?php echo 'a' . 'b', $x and $y; foreach ($a as $k => [$b, , $c]) { static fn() => $k instanceof D; }",
        "﻿<?php\r\nnamespace A\\B;\r\nuse function X\\y;\r\nabstract class Z { abstract protected function q(array $a): void; }\r\n",
    ],
    "sql": [
        "SELECT DISTINCT a b, count(*) OVER (PARTITION BY c ORDER BY d) AS n, CASE WHEN x THEN 1 ELSE 2 END y, 'a' 'b' z, CAST(q AS double precision) FROM t u; SELECT 1 one",
        "CREATE TABLE `a` (x INT DEFAULT 'it''s', [y] TEXT, \"z\" INT);\n-- don't\nINSERT INTO t (a) VALUES ('x;('), ('b');",
        "# it's a note\nUPDATE t SET a = 'it\\'s' WHERE b = 1; SELECT '\\' FROM t".replace("; SELECT '\\' FROM t", ""),
        "SELECT 'C:\\' AS p; DELETE FROM t WHERE x < 3",
        "CREATE FUNCTION f() RETURNS int AS $$ begin return 'a; end $$ LANGUAGE plpgsql;",
        "ALTER TABLE t ADD COLUMN c INT; DROP TABLE IF EXISTS t; CREATE UNIQUE INDEX i ON t (a, b); CREATE VIEW v AS SELECT 1",
        "WITH a AS (SELECT 1) SELECT * FROM a; COMMIT; BEGIN; SET x = 1",
        "CREATE OR REPLACE FORCE VIEW v AS SELECT 1; DELETE t FROM t JOIN u ON t.a = u.a; DELETE FROM t; CREATE TEMPORARY TABLE x (a INT); ALTER VIEW v AS SELECT 2; DROP MATERIALIZED VIEW v",
        "INSERT INTO tmp VALUES\n(1, 2, 'ab'),\n(3, -4, 'cd');\n",
    ],
    "typescript": [
        "import { A } from './a';\nexport function f<T>(a: T[], b = 3): Record<string, number> { const r = /[/'\"]\\//g; return `x ${a.map((q) => `{${q}`)} (`; } // don't",
        "interface A { b?: string; readonly c: number }\ntype B = keyof A | 'x';\nabstract class D extends E { private f = async () => { await g(); }; }\n",
        "const f = (s: string) => { return /x{/.test(s) || /[}]/.test(s); }; const g = () => typeof /(/;",
        "export const A = () => (<ul className='a'>{items.map((i) => <li key={i} {...i}>don't {`${i}`} <B.C/></li>)}<></></ul>);\nconst b = a < c, d = <T>(x: T) => x;",
        "const a = b / c / d;\nlet s = \"it's\", t = 'a\\\nb';\nfor (const x of y) { label: while (true) break }\nexport default a as unknown;",
    ],
    "python": [
        "try:\n    a\nexcept (A, B) as e:\n    pass\nelse:\n    b\nfinally:\n    c\n", "match x:\n    case [1, *r] if r:\n        y = f\"{a[\"k\"]!r} {{\"\n    case _:\n        pass\nmatch = 3\n",
        "x = (1,\n  2)\nif x: y = 4.\nelse: z = x[1:, ::2]\n@d(1)\nasync def f(a, /, b: int = 1, *, c) -> dict[str, int]:\n\treturn a if b else lambda: c\n", "from . import *\nfrom a import (b,\n c)\nimport d.e as f, g\n",
        "s = 'a' 'b' \\\n  'c'\nclass A[T](B, metaclass=C): x: int = 3; y = ...\n",
    ] + ["def f(x):\n    '''it's ('''\n    return {'a': [1, (2)]} # don't\n", 'x = """\n<<<<<<< HEAD\n"""\n', "f'{a!r:>{w}}'\n"],
}
BAD = {
    "php": [
        "UPDATE a SET b = 1;", "no tag", "<?php class A { function f() { }", "<?php $a = 'open;\n$b = 1;\n", "<?php f(]);", "<?php }", "<?php /* open",
        "<?php $a = <<<TXT\nnever closed\n", "<?php\nclass A {\n<<<<<<< HEAD\n$a;\n=======\n$b;\n>>>>>>> x\n}", "<?php $count = (7 + ;", "<?php function (asset { }",
        "<?php This is prose about the weather.", "<?php use A\\B;\nuse C", "<?php $x = ;", "<?php class 9lives {}", "<?php\r\n$a = 1;\r\n<<<<<<< HEAD\r\n$b = 2;\r\n", "<?php $a = = 3;",
        "<?php\n$x = 1\n$y = 2;", "<?php class A extends { }", "<?php f($a)\n$y = 2;", "<?php $a = \"x {$b[\"k\"} y\";",
    ],
    "sql": [
        "# Title\n\nWhen the cat sleeps it dreams.\n", "CREATE TABLE t (a INT", "UPDATE p SET note = 'open WHERE id = 3;\n", "SELECT a,, b FROM t;", "DELETE FROM", "<?php echo 1;",
        "INSERT INTO t (a) VALUES", "CREATE TABLE t (a INT));", "import x from 'y';", "UPDATE t SET a", "CREATE TABEL t (id INT);", "DELETE FORM t WHERE a = 1;", "DROP TABEL t;", "ALTER TABEL t ADD c INT;",
        "select 1 frm t", "SELECT a, b c d FROM t",
    ],
    "typescript": ["function f() {", "const a = `x ${b", "const a = 'x\nconst b = 1;", "def f(x):\n    return x\n", "CREATE TABLE t (a INT);", "<?php echo 1;", "const a = (1];", "let total = = 3;", "const = 4;", "exprot function f() {}", "class 9a {}", "export function f(a: number", "class A extends { }", "const a = <div>{x</div>;", "const a = <div><b></div>;"],
    "python": ["def f(x):\n  return (x\n", "x = 'a\n", "def (x):\n    pass\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "const a = {};\n", "for x in y:\n", "'''open",
        "if x:\npass\n", "x = 1\n  y = 2\n", "if x:\n    a\n  b\n", "try:\n    a\nb = 1\n", "else:\n    a\n", "print 'x'\n", "x = = 3\n", "import a from 'b'\n", "def f(a b):\n    pass\n", "x = f'{a\n",
        "while True\n    pass\n", "class 9a:\n    pass\n", "x = [1, 2\ny = 3\n", "return (a +)\n", "try:\n    a\n", "function f() { return 1; }\n"],
}


ROUTINES = [
    "DELIMITER //\nCREATE PROCEDURE p(IN a INT)\nBEGIN\n  IF a THEN SET @x = CASE WHEN a THEN 1 ELSE 2 END; END IF;\n  CALL q();\nEND//\nDELIMITER ;\nSELECT 1;",
    "DELIMITER $$\nCREATE DEFINER=`r`@`h` TRIGGER t BEFORE INSERT ON u FOR EACH ROW BEGIN SET NEW.a = 1; END$$\nCREATE FUNCTION f() RETURNS INT BEGIN RETURN 1; END $$\nDELIMITER ;\n",
    "CREATE OR REPLACE PROCEDURE p IS\n  n NUMBER;\n  m NUMBER := 2;\nBEGIN\n  n := m;\nEND p;\n/\nCREATE TABLE a (x INT);",
    "CREATE PACKAGE BODY k AS\n PROCEDURE a IS BEGIN NULL; END a;\n PROCEDURE b IS BEGIN NULL; END b;\nEND k;\n/\nDROP TABLE t;",
    "DECLARE\n x NUMBER;\n y NUMBER;\nBEGIN\n x := y;\n BEGIN NULL; END;\nEND;\n/\n",
    "CREATE PROCEDURE p AS\nBEGIN\n  SELECT 1\n  BEGIN TRY SELECT 2 END TRY BEGIN CATCH SELECT 3 END CATCH\nEND\nGO\nSELECT 4\nGO\n",
    "IF EXISTS (SELECT 1) BEGIN SELECT 1; SELECT 2; END ELSE BEGIN SELECT 3; END;\nDECLARE @x INT; BEGIN TRANSACTION; UPDATE t SET a = 1; COMMIT;",
    "CREATE TABLE spans (begin DATE, end DATE); SELECT begin, end FROM spans; CREATE TRIGGER t BEFORE INSERT ON u FOR EACH ROW SET NEW.a = 1;",
    "BEGIN; UPDATE t SET a = CASE WHEN b THEN 1 ELSE 2 END; END;",
]
NO_ROUTINES = [
    "BEGIN; CREATE TABLE a (x int); INSERT INTO a (x) VALUES", "function pick(a) { return a + 1; }", "BEGIN TRANSACTION; CREATE TABEL t (id INT); COMMIT;", "DECLARE @x INT; DELETE FORM t;",
    "CREATE PROCEDURE p()\nBEGIN\n  SELECT 1;\n", "DELIMITER //\nCREATE PROCEDURE p() BEGIN SELECT 1; END//\nDELIMITER ;\nDROP TABEL t;", "CREATE TABLE t (a INT); the trigger was moved;",
    "CREATE PROCEDURE p() BEGIN SELECT 1; END; INSERT INTO a (x) VALUES", "CREATE PACKAGE k AS PROCEDURE a;", "package main; func f() { }",
]


@pytest.mark.parametrize("text", ROUTINES)
def test_routines_and_blocks(text):
    assert fault_of("sql", text) is None


@pytest.mark.parametrize("text", NO_ROUTINES)
def test_words_of_routines_excuse_nothing(text):
    assert fault_of("sql", text)


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid(language, text):
    assert fault_of(language, text) is None


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in BAD.items() for t in ts])
def test_invalid(language, text):
    assert fault_of(language, text)


def test_tables(spark):
    schema = "file_id long, repo_id long, language string, content string, fault string"
    rows = [
        (1, 1, "php", "<?php f(", "q"), (1, 1, "php", "<?php f(", "q"), (2, 1, "php", None, "q"), (3, 1, "PHP", "", "q"), (4, None, "python", "x = (", "q"),
        (5, 2, None, "((((", "q"), (6, 2, "go", "((((", "q"), (7, 1, "php", "<?php " + "f('x'); " * 50_000, "q"), (8, 1, "php", " \n", "q"),
    ]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.file_id for r in invalid_files(df).collect()) == [1, 4]
    rates = {(r.repo_id, r.language): (r.n_files, r.n_invalid, r.invalid_rate) for r in invalid_rates(df).collect()}
    assert rates[1, "php"] == (4, 1, 0.25) and rates[None, "python"] == (1, 1, 1.0)
    assert invalid_files(df.limit(0)).count() == 0
