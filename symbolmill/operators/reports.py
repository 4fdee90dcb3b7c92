"""Repository-level reports: status, modules, dependencies, conventions.

Every figure is one aggregation with map-side combine over narrow rows; joins are by id.
Inputs are the code index with repeated rows already dropped by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolmill.functions.names import as_column, class_part, first_namespace, symbol_key

#: Layers by the order in which they are tried, with the folder (and symbol) names that mean them.
ARCHITECTURE = (
    ("Route", "routes?"), ("Controller", "controllers?"), ("Builder", "builders?"), ("Model", "models?"), ("Repository", "repositories|repository"),
    ("DataObject", "dataobjects?"), ("Handler", "handlers?"), ("Report", "reports?"),
)
STAFF_PAGE, LEGACY_PAGE = ("Staff Page", "staff"), ("Legacy Page", "pages?|legacy")
#: Layers through which frameworks reach code that touches tables.
BRIDGES = ("Route", "Controller", "Builder", "Model", "Repository", "DataObject", "Handler")
#: Layers of planned symbols, by the end of a name or a folder.
PLANNED = ("Route", "Controller", "Builder", "Model", "Repository", "Service", "Handler", "DataObject", "Entity", "Report", "Page", "Test")
#: Layers of modules, the highest first; a lower one should not depend on a higher one.
MODULE_LAYERS = ("controllers", "http", "services", "repositories", "models", "traits")


def rate(n: Column, d: Column) -> Column:
    """Percentage with one decimal, below 100 unless complete."""
    return F.when(d <= 0, F.lit(0.0)).when(n >= d, F.lit(100.0)).otherwise(F.least(F.lit(99.9), F.floor(n / d * 1000 + 0.5) / 10))


def module_of(path: Column | str) -> Column:
    """The first two segments of a path; the first one where there are no more than two."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 2, parts[0]).otherwise(F.concat_ws("/", parts[0], parts[1]))


def is_test_path(path: Column | str) -> Column:
    """A ``test(s)``/``spec`` segment, ``*test.php`` or ``*spec.<ext>``."""
    return F.regexp_like(F.col(path) if isinstance(path, str) else path, F.lit(r"(?i)(?:^|/)(?:tests?|spec)/|test\.php$|spec\.\w+$"))


def layer_of(path: Column | str, symbol: Column | str | None = None) -> Column:
    """the first layer whose name is a folder of the path, or a part of the symbol's name, in any case; null symbols have none."""
    low = F.lower(as_column(path))
    name = F.lower(F.coalesce(as_column(symbol), F.lit(""))) if symbol is not None else F.lit("")
    folder = lambda names: F.regexp_like(low, F.lit(rf"(^|[\\/])(?:{names})([\\/]|$)"))
    part = lambda names: F.regexp_like(name, F.lit(rf"(^|\\|::|\$)(?:{names})s?($|\\|::)"))
    out = F.when(folder(STAFF_PAGE[1]), STAFF_PAGE[0]).when(folder(LEGACY_PAGE[1]), LEGACY_PAGE[0]).otherwise("Other")
    for layer, names in reversed(ARCHITECTURE):
        out = F.when(folder(names) | part(names), layer).otherwise(out)
    return out


def planned_layer(name: Column | str, path: Column | str) -> Column:
    """the first layer that ends the name (as written) or is a folder inside the path."""
    out = F.lit("Other")
    for layer in reversed(PLANNED):
        out = F.when(F.endswith(as_column(name), F.lit(layer)) | F.contains(F.lower(as_column(path)), F.lit(f"/{layer.lower()}/")), layer).otherwise(out)
    return out


def module_layer(module: Column | str) -> Column:
    """Position of the first module layer that occurs in the module's path, null without one."""
    out = F.lit(None).cast("int")
    for i, layer in reversed(list(enumerate(MODULE_LAYERS))):
        out = F.when(F.contains(F.lower(as_column(module)), F.lit(layer)), i).otherwise(out)
    return out


def status(files: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """A1/A2/A8 per repository: files, symbols, references, resolved ones and their rate."""
    owner = symbols.select(F.col("symbol_id").alias("source_symbol_id"), "file_id").join(files.select("file_id", "repo_id"), "file_id")
    f = files.groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum("lines_of_code").alias("n_lines"))
    s = symbols.join(files.select("file_id", "repo_id"), "file_id").groupBy("repo_id").agg(F.count("*").alias("n_symbols"))
    r = references.select("source_symbol_id", "target_symbol_id").join(owner, "source_symbol_id").groupBy("repo_id").agg(
        F.count("*").alias("n_references"), F.count("target_symbol_id").alias("n_resolved")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = f.join(s, "repo_id", "left").join(r, "repo_id", "left").withColumns({c: zero(c) for c in ("n_symbols", "n_references", "n_resolved")})
    return out.withColumn("resolved_rate", rate(F.col("n_resolved"), F.col("n_references")))


#: Names of test tools, pseudo-types, and the classes PHP and its usual extensions define without a namespace.
TEST_TOOLS = r"^phake(?:::|\\|$)|^phpunit(?:::|\\|$)|^mockery(?:::|\\|$)|^m::"
PSEUDO_TYPES = ("parent", "self", "static")
PHP_CLASSES = (
    "arithmeticerror arrayaccess arrayiterator arrayobject backedenum badmethodcallexception callbackfilteriterator cachingiterator closure countable dateinterval "
    "datetime datetimeimmutable datetimeinterface datetimezone dateperiod directory directoryiterator divisionbyzeroerror domainexception domattr domcdatasection "
    "domcharacterdata domcomment domdocument domelement domentity domentityreference domexception domimplementation domnamednodemap domnode domnodelist domnotation "
    "domprocessinginstruction domtext domxpath emptyiterator error errorexception exception filteriterator filesystemiterator globiterator generator imagick imagickdraw "
    "imagickexception imagickpixel invalidargumentexception iterator iteratoraggregate iteratoriterator jsonexception jsonserializable lengthexception limititerator "
    "logicexception multipleiterator norewinditerator outofboundsexception outofrangeexception oauthexception outeriterator overflowexception pdo pdostatement redis "
    "redisarray rediscluster redissentinel recursivearrayiterator recursivedirectoryiterator recursivefilteriterator recursiveiterator recursiveiteratoriterator "
    "reflection reflectionclass reflectionexception reflectionfunction reflectionmethod reflectionobject reflectionparameter reflectionproperty regexiterator "
    "runtimeexception seekableiterator serializable soapclient soapfault soapheader soapparam soapserver soapvar simplexmlelement splfileinfo splfileobject "
    "splobjectstorage spltempfileobject stdclass stringable throwable tidy traversable typeerror underflowexception unexpectedvalueexception unitenum valueerror "
    "xmlreader xmlwriter xsltprocessor ziparchive"
).split()


def unresolved_categories(references: DataFrame, sources: DataFrame, external: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(category, n_references, n_potential_internal, n_production_internal) of unresolved references, by eight rules in order.

    ``sources`` is (source_symbol_id, path). Third parties are the symbols and namespaces of
    ``external``, not a list of names. Names are classified once per kind of source and then
    weighed, so hot targets are a few rows.
    """
    place = F.when(F.startswith("path", F.lit("cache/")), "cache").when(F.startswith("path", F.lit("tests/")), "tests").otherwise("code")
    rows = references.filter("target_symbol_id is null and target_qualified_name is not null").select("source_symbol_id", symbol_key("target_qualified_name").alias("t"))
    rows = rows.groupBy("source_symbol_id", "t").agg(F.count("*").alias("n")).join(sources.select("source_symbol_id", place.alias("place")), "source_symbol_id", "left")
    names = rows.groupBy("t", F.coalesce("place", F.lit("code")).alias("place")).agg(F.sum("n").alias("n"))
    vendors = external.filter("qualified_name is not null").select(symbol_key("qualified_name").alias("q"))
    spaces = vendors.filter(F.instr("q", "\\") > 1).select(first_namespace("q").alias("p")).distinct().withColumn("vendor", F.lit(True))
    globals_ = vendors.filter(F.instr("q", "\\") == 0).select(F.col("q").alias("c")).distinct().withColumn("global", F.lit(True))
    own = prefixes.select(F.col("prefix").alias("p")).distinct().withColumn("own", F.lit(True))
    rows = names.withColumn("c", class_part("t")).withColumn("p", F.when(F.instr("t", "\\") > 1, first_namespace("t")))
    rows = rows.join(spaces, "p", "left").join(own, "p", "left").join(globals_, "c", "left")
    bare, leaf = F.col("p").isNull(), F.substring_index("c", "\\", -1)
    category = (
        F.when(F.col("place") == "cache", "generated_cache").when(F.regexp_like("t", F.lit(TEST_TOOLS)), "test_framework").when(leaf.isin(*PSEUDO_TYPES), "static_self")
        .when(bare & (leaf.isin(*PHP_CLASSES) | F.startswith("t", F.lit("pdo::"))), "php_builtin").when(F.col("place") == "tests", "test_only")
        .when(F.col("vendor") | (bare & F.col("global")) | (~bare & F.col("own").isNull()), "external_vendor")
        .when(~bare | (F.col("c") != ""), "potential_internal_miss").otherwise("unknown")
    )
    inner = F.col("category").isin("potential_internal_miss", "unknown")
    zero = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rows.withColumn("category", category).groupBy("category").agg(
        F.sum("n").alias("n_references"), zero(inner).alias("n_potential_internal"), zero(inner & (F.col("place") == "code")).alias("n_production_internal")
    )


def source_labels(files: DataFrame) -> DataFrame:
    """A5: files per label, the text between ``@`` and the first slash (``repo`` without)."""
    label = F.when(F.startswith("path", F.lit("@")), F.expr("substring(substring_index(path, '/', 1), 2)")).otherwise("repo")
    return files.groupBy(label.alias("label")).agg(F.count("*").alias("n_files"))


def namespace_prefixes(symbols: DataFrame) -> DataFrame:
    """Distinct first namespace segments of top-level symbols."""
    return symbols.filter("parent_symbol_id is null and qualified_name is not null").select(F.lower(first_namespace("qualified_name")).alias("prefix")).distinct()


def module_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A10."""
    rows = symbols.join(files.select("file_id", module_of("path").alias("module")), "file_id")
    return rows.groupBy("module").agg(
        F.countDistinct("file_id").alias("n_files"), F.count("*").alias("n_symbols"), F.count_if(F.col("kind") == "class").alias("n_classes"),
        F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"),
    )


def module_table(files: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Top-level symbols with incoming references and the names they implement, extend and use."""
    tops = symbols.filter("parent_symbol_id is null").join(files.select("file_id", module_of("path").alias("module")), "file_id").select("symbol_id", "module", "qualified_name", "kind")
    incoming = references.filter("target_symbol_id is not null").groupBy(F.col("target_symbol_id").alias("symbol_id")).agg(F.count("*").alias("n_incoming"))
    names = lambda k: F.array_join(F.sort_array(F.collect_set(F.when(F.col("reference_kind") == k, symbol_key("target_qualified_name")))), ",")
    kinds = references.filter(F.col("reference_kind").isin("implementation", "inheritance", "trait_use")).groupBy(F.col("source_symbol_id").alias("symbol_id")).agg(
        names("implementation").alias("implements"), names("inheritance").alias("extends"), names("trait_use").alias("traits")
    )
    out = tops.join(incoming, "symbol_id", "left").join(kinds, "symbol_id", "left")
    return out.withColumns({"n_incoming": F.coalesce("n_incoming", F.lit(0).cast("long"))} | {c: F.coalesce(c, F.lit("")) for c in ("implements", "extends", "traits")})


def _ends(files: DataFrame, symbols: DataFrame, references: DataFrame, value: Column) -> DataFrame:
    """(src, dst) of resolved references, ``value`` taken from the files of both ends."""
    at = symbols.select("symbol_id", "file_id").join(files.select("file_id", value.alias("v")), "file_id").select("symbol_id", "v")
    rows = references.select("source_symbol_id", "target_symbol_id").filter("target_symbol_id is not null")
    rows = rows.join(at.select(F.col("symbol_id").alias("source_symbol_id"), F.col("v").alias("src")), "source_symbol_id")
    return rows.join(at.select(F.col("symbol_id").alias("target_symbol_id"), F.col("v").alias("dst")), "target_symbol_id").select("src", "dst")


def module_dependencies(files: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """References between different modules."""
    rows = _ends(files, symbols, references, module_of("path"))
    return rows.filter("src <> dst").groupBy(F.col("src").alias("source_module"), F.col("dst").alias("target_module")).agg(F.count("*").alias("n_references"))


def layer_violations(files: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Dependencies between modules (A12) that lead from a lower layer to a higher one."""
    rows = module_dependencies(files, symbols, references)
    return rows.filter(module_layer("source_module") > module_layer("target_module"))


def external_namespaces(references: DataFrame) -> DataFrame:
    """Unresolved references with a namespace, per first segment."""
    rows = references.filter("target_symbol_id is null").select(symbol_key("target_qualified_name").alias("t")).filter(F.instr("t", "\\") > 0)
    return rows.groupBy(first_namespace("t").alias("namespace")).agg(F.count("*").alias("n_references"))


def kind_counts(references: DataFrame) -> DataFrame:
    """A14."""
    return references.groupBy("reference_kind").agg(F.count("*").alias("n_references"), F.countDistinct("source_symbol_id").alias("n_sources"))


def interface_adoption(files: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """A15/A17/J11 per module: classes, and those with an interface, a base and traits."""
    has = references.groupBy(F.col("source_symbol_id").alias("symbol_id")).agg(
        *[F.max((F.col("reference_kind") == k).cast("int")).alias(k) for k in ("implementation", "inheritance", "trait_use")]
    )
    rows = symbols.filter("kind = 'class'").join(files.select("file_id", module_of("path").alias("module")), "file_id").join(has, "symbol_id", "left")
    return rows.groupBy("module").agg(
        F.count("*").alias("n_classes"), F.count_if(F.col("implementation") == 1).alias("n_with_interface"),
        F.count_if(F.col("inheritance") == 1).alias("n_with_base"), F.count_if(F.col("trait_use") == 1).alias("n_with_traits"),
    )


def naming_ratios(symbols: DataFrame) -> DataFrame:
    """A16 per kind, over all symbols."""
    share = lambda p: F.round(F.avg(F.regexp_like("name", F.lit(p)).cast("double")), 6)
    return symbols.filter("name is not null").groupBy("kind").agg(
        F.count("*").alias("n_symbols"), share(r"^[A-Z][A-Za-z0-9]*$").alias("pascal_case"), share(r"^[a-z][A-Za-z0-9]*$").alias("camel_case"), share(r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$").alias("snake_case"),
    )


def blast_radius(files: DataFrame, symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """Symbols reached (node) grouped by their file, with their kinds."""
    rows = reached.select(F.col("node").alias("symbol_id")).join(symbols.select("symbol_id", "file_id", "kind"), "symbol_id").join(files.select("file_id", "path"), "file_id")
    return rows.groupBy("path").agg(F.count("*").alias("n_symbols"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def blast_top(blast: DataFrame, shown: int = 10) -> DataFrame:
    """The ``shown`` files with most symbols reached, and one row (path null) with the number of other files and of their symbols."""
    top = blast.orderBy(F.desc("n_symbols"), "path").limit(shown).select("path", F.lit(1).cast("long").alias("n_files"), "n_symbols")
    rest = blast.join(top.select("path"), "path", "left_anti").agg(F.count("*").alias("n_files"), F.sum("n_symbols").alias("n_symbols"))
    return top.unionByName(rest.filter("n_files > 0").select(F.lit(None).cast("string").alias("path"), "n_files", "n_symbols"))


def age_text(seconds: Column) -> Column:
    """An age in whole seconds, minutes, hours or days."""
    unit = lambda size, sign: F.concat(F.floor(seconds / size).cast("string"), F.lit(sign))
    return F.when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def freshness(repos: DataFrame, now: Column, stale_hours: int = 24) -> DataFrame:
    """Age of each repository's index in whole hours, and whether it is stale; unknown times have neither."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_indexed_at").cast("timestamp"))
    hours = F.floor(seconds / 3600)
    return repos.select("repo_id", hours.alias("age_hours"), age_text(seconds).alias("age"), (hours > stale_hours).alias("is_stale"))
