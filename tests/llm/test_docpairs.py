import pytest

from symbolmill.llm.docpairs import description_of, documented_functions, documented_symbols, islands, prose

SAID = "The nested batch folds each report of the ledger."
PHP = f"""<?php
/** {SAID} */
function first(): int {{ return 1; }}

/**
 * {SAID}
 *
 * @param int $x and a long note on what it is for here
 */
#[Attr(a: [1, ')'])]
#[Other]

final public static function second(
    array $x,
): void {{
    $s = "/** not a comment */ function fake() {{"; // }} don't
    $t = <<<TXT
/** {SAID} */
function nothing() {{
TXT;
    $f = fn($y) => function () use ($y) {{ return '}}'; }};
}}

/** {SAID} */
// a note between
function third() {{}}

/** {SAID} */
/** - */
abstract protected function fourth();
/* {SAID} */
function fifth() {{}}
"""


def test_php_islands():
    found = {i.name: i for i in islands(PHP, "php")}
    assert list(found) == ["first", "second", "third", "fourth", "fifth"]
    assert found["first"].line == 3 and prose(found["first"].doc) == SAID
    assert found["second"].line == 13 and prose(found["second"].doc) == SAID
    assert found["second"].signature == "final public static function second( array $x, ): void"
    assert PHP[found["second"].start : found["second"].end].endswith("};\n}")
    assert found["third"].doc is None and found["fifth"].doc is None and found["fourth"].doc == "/** - */"
    assert [(i.name, i.line) for i in islands(PHP.replace("\n", "\r\n"), "php")] == [(i.name, i.line) for i in islands(PHP, "php")]
    assert [i.line for i in islands(PHP.replace("\n", "\r"), "php")] == [i.line for i in found.values()]


def test_other_languages():
    ts = f"/** {SAID} */\nexport async function go<T>(a: T): Promise<T> {{ return `}} ${{a}}`; }}\nclass A {{\n  /** {SAID} */\n  @Dec({{a: 1}})\n  private run(x: number): void {{ if (x) {{ f(x); }} }}\n}}\n"
    assert [(i.name, i.line, bool(i.doc)) for i in islands(ts, "typescript")] == [("go", 2, True), ("run", 6, True)]
    py = f'@dec(1)\ndef f(x,\n      y):\n    """{SAID}"""\n    return {{"a": 1}}\n\n\nclass A:\n    async def g(self):\n        # no\n        return "def h(): pass"\n'
    found = islands(py, "python")
    assert [(i.name, i.line, i.doc) for i in found] == [("f", 2, SAID), ("g", 9, None)]
    assert py[found[0].start : found[0].end].endswith('{"a": 1}\n\n') or '"a": 1' in py[found[0].start : found[0].end]
    sql = f"/** {SAID} */\nCREATE FUNCTION add_one(x int) RETURNS int AS 'x';\n"
    assert [(i.name, bool(i.doc)) for i in islands(sql, "sql")] == [("add_one", True)]


@pytest.mark.parametrize(
    ("doc", "said"),
    [
        (f"/** {SAID} */", True), (f"/**\n{SAID}\n*/", True), (f"/**\r\n * {SAID}\r\n */", True), (f"/** @param int $x {SAID} */", False),
        (f"/**\n * <code>\n * {SAID}\n * </code>\n */", False), (f"/**\n * ```\n * {SAID}\n * ```\n */", False), ("/** {@inheritdoc} */", False), ("/** */", False), (None, False),
        ("/**\n * -----\n */", False), ("/** Fold nested batch. */", False), ("/** foldNestedBatch() fold nested batch fold nested batch fold */", False),
        ("/** TODO (abc-12): write the documentation of this method before the next release. */", False),
        ("/** Documentation for this function is still missing (x-1), please add it when you can. */", False),
        ("/** Hier fehlt noch die Beschreibung (x-2), bitte vor der Abnahme ergänzen. */", False),
        ("/** A missing column must not reach the signal: it exports it. */", True),
        ("/**\n * Quand le passage est périmé, le filtre reste bloqué.\n * @return int\n */", True),
    ],
)
def test_descriptions(doc, said):
    assert (description_of(doc, "foldNestedBatch") is not None) == said


def test_tables(spark):
    files = spark.createDataFrame(
        [(1, "php", PHP, "n"), (1, "php", PHP, "n"), (2, "php", None, "n"), (3, None, PHP, "n"), (4, "php", "", "n"), (5, "php", "<?php\n" + f"/** {SAID} */\nfunction a() {{ x(); }}\n" * 3000, "n")],
        "file_id long, language string, content string, name string",
    )
    symbols = spark.createDataFrame(
        [(10, 1, "function", "first", 3, "d"), (10, 1, "function", "first", 3, "d"), (11, 1, "method", None, 13, "d"), (12, 1, "method", "third", 28, "d"), (13, 1, "class", "first", 3, "d"),
         (14, 2, "function", "first", 3, "d"), (15, None, "function", "first", None, "d"), (16, 1, "function", "other", 3, "d"), (17, 5, "function", "a", 3, "d"), (18, 1, "function", "first", 9999, "d")],
        "symbol_id long, file_id long, kind string, name string, line_start int, description string",
    )
    rows = documented_symbols(symbols, files).collect()
    assert sorted(r.symbol_id for r in rows) == [10, 11, 17]
    one = next(r for r in rows if r.symbol_id == 10)
    assert (one.signature, one.code, one.description) == ("function first(): int", "function first(): int { return 1; }", SAID)
    assert documented_functions(files).filter("file_id = 5").count() == 3000
    assert documented_symbols(symbols.limit(0), files.limit(0)).count() == 0


TYPESCRIPT = """
import { a } from './b';
/** D1 */
export class A<T extends { x: string }> extends B {
  /** D2 */
  private readonly re = /['"{]/g;
  /** D3 */
  constructor(private a: string, cb: (e: Error) => void) { super(); foo(a); }
  /** D4 */
  handler = async (e: Event): Promise<{ a: string }> => { await go(e); };
  /** D5 */
  public find<K extends { id: number }>(key: K, f: (x: K) => boolean = (x) => true): { ok: boolean } | null { if (x) { return null; } }
  /** D6 */
  abstract run(a: string): void;
  /** D7 */
  @Input() get value(): string { return this.v; }
  /** D8 */
  other: (a: number) => string = (a) => `${a}`;
}
/** D9 */
export interface I {
  /** D10 */
  load(id: string, opts?: { deep: boolean }): Promise<void>;
  /** D11 */
  name: string;
}
/** D12 */
export const add = (a: number, b: number): number => a + b;
/** D13 */
const f2 = async function* named(x) { yield x; };
/** D14 */
export default async function go<T>(x: T, { y, z }: { y: number; z: () => void }) { return y; }
/** D15 */
const obj = {
  /** D16 */
  key: (v) => { return v; },
  /** D17 */
  meth(v) { return v; },
  /** D18 */
  num: 3,
};
/** D19 */
declare function decl(a: string): number;
/** D20 */
foo(a);
/** D21 */
const notf = a < b, c = (d);
/** D22 */
const one = x => x * 2;
if (x) { bar(); }
/** D23 */
export const useIt: Handler<{ a: string }> = (e) => { e(); };
"""


def test_typescript_islands():
    documented = {i.name: i.doc.strip("/* ") for i in islands(TYPESCRIPT, "typescript") if i.doc}
    assert documented == {
        "constructor": "D3", "handler": "D4", "find": "D5", "run": "D6", "value": "D7", "other": "D8", "load": "D10", "add": "D12", "f2": "D13", "go": "D14",
        "key": "D16", "meth": "D17", "decl": "D19", "one": "D22", "useIt": "D23",
    }
    at = {i.name: (i.signature, TYPESCRIPT[i.start : i.end]) for i in islands(TYPESCRIPT, "typescript")}
    assert at["find"][1].endswith("if (x) { return null; } }") and at["find"][0].endswith("{ ok: boolean } | null")
    assert at["add"][1].endswith("=> a + b") and at["load"][1].endswith("Promise<void>") and at["handler"][0].endswith("Promise<{ a: string }> =>")
