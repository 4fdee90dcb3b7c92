from symbolmill.llm.foreign import foreign_files

FILES = "file_id long, path string, source_label string, language string, content string, reasons string"
EXTERNAL = "symbol_id long, qualified_name string, kind string, package_name string"
HAND = "<?php\n\nnamespace App\\Model;\n\nuse Acme\\Http\\Client;\n\nclass Order\n{\n    // Rows generated by hand are rare.\n    public function total(): int { return 3; }\n}\n"
BANNER = "<?php\nclass Writer\n{\n    public function head(): string\n    {\n        return '// Code generated by tool. DO NOT EDIT.';\n    }\n}\n"


def test_kinds(spark):
    minified = "<?php " + "".join(f"function a{i}($x){{return $x+{i};}}" for i in range(80))
    numbers = "INSERT INTO t VALUES\n" + ",\n".join(f"({i * 7919}, {i * 104729}, {i})" for i in range(60)) + ";\n"
    encoded = "<?php\nreturn base64_decode('" + "aB3+/xYz" * 200 + "');\n"
    template = "<?php\nclass C\n{\n" + "".join(f"    public function getField{i:04}() {{ return $this->slots['f{i:04}']; }}\n" for i in range(40)) + "}\n"
    yes = {
        1: ("a/b.php", "repo", "php", minified), 2: ("db/a.sql", None, "sql", numbers), 3: ("a.php", "repo", "php", encoded), 4: ("a.php", "repo", "php", template),
        5: ("vendor/acme/http/a.php", "repo", "php", HAND), 6: ("@third-party/x/a.php", "third-party", "php", None), 7: ("a.min.php", None, "php", ""),
        8: ("a.php", "repo", "php", "<?php\n// Code generated by tool v1.2. DO NOT EDIT.\n" + HAND[6:]),
        9: ("a.php", "repo", "php", HAND.replace("App\\Model", "Acme\\Http\\Internal")),
        10: ("a.sql", "repo", "sql", "SELECT 1;\n\n-- Diese Datei wurde von x erzeugt und bei jedem Lauf überschrieben.\n"),
        11: ("a.ts", "repo", "typescript", "/*\n * Part of the acme/http package, release 3.\n */\nexport const a = 1;\n"),
        12: ("build/stubs/x.pb.php", "repo", "php", HAND), 13: ("src/Generated/X.php", "repo", "php", HAND),
    }
    escaped = "<?php\n$s = \"" + "\\x41\\x7f" * 60 + "\";\n"
    signs = "<?php\n" + "$_=('['^')').(')'^']');$__='_'.(($_^'@')|'!');" * 12 + "\n"
    yes |= {14: ("a.php", "repo", "php", escaped), 15: ("a.php", "repo", "php", signs), 16: ("a.xyz", "repo", None, numbers), 17: ("a.sql", "repo", "sql", "INSERT INTO t VALUES (1, 2);\n" * 16)}
    no = {
        60: ("a.sql", "repo", "sql", "INSERT INTO t VALUES (1, 2);\n" * 4), 61: ("a.php", "repo", "php", "<?php return 86400;"), 62: ("a.php", "repo", "php", "<?php\n// 数据的说明文字，不是代码。\n" + HAND[6:]),
        50: ("app/Order.php", "repo", "php", HAND), 51: ("app/Writer.php", "repo", "php", BANNER), 52: ("src/vendor_portal/a.php", "repo", "php", HAND), 53: ("app/Vendor/Rating.php", "repo", "php", HAND),
        54: ("app/GeneratedReport.php", "repo", "php", "<?php\n// Not generated: edit freely, the builder only reads this file.\n" + HAND[6:]), 55: ("src/Cache/AStore.php", "repo", "php", HAND),
        56: (None, None, None, None), 57: ("a.php", "repo", "php", "<?php\n// Counts generated rows per order and vendor.\n" + HAND[6:]),
        58: ("a.php", "repo", "php", "<?php\n/* Part of the other/lib package. */\n" + HAND[6:]),
    }
    rows = [(i, *v, "x") for d in (yes, no) for i, v in d.items()]
    ext = spark.createDataFrame([(1, "Acme\\Http\\Client", "class", "acme/http"), (2, None, None, None)], EXTERNAL)
    got = {r.file_id: r.reasons for r in foreign_files(spark.createDataFrame(rows + rows[:3], FILES), ext).collect()}
    assert set(got) == set(yes), got
    assert "encoded" in got[14] and "packed" in got[15] and got[17] == ["template"]
    assert got[1] == ["minified"] and got[9] == ["package namespace"] and got[11] == ["package comment"]
    assert foreign_files(spark.createDataFrame([], FILES), ext.limit(0)).count() == 0
