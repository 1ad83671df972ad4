"""Name resolution by the kind of key that a reference carries, as joins of tiers over all files.

Every distinct key is resolved once; references then take its result by a join that stays balanced under hot keys. A tier only sees what the tiers
before it left open, and a key is resolved only where exactly one definition matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.functions.text import suffixes
from factloom.operators.resolve import _best
from factloom.operators.skew import balanced_left_join
from factloom.session import Scratch

#: Decorators that leave what a name stands for as it is.
TRANSPARENT = ("staticmethod", "classmethod", "property", "abstractmethod", "abc.abstractmethod", "dataclass", "dataclasses.dataclass")
#: Names of standard classes that begin with a small letter; other such external names are taken for functions.
LOWERCASE_CLASSES = (
    "datetime", "date", "time", "timedelta", "timezone", "tzinfo", "defaultdict", "deque", "partial", "partialmethod", "socket", "array", "property", "staticmethod", "classmethod", "count", "cycle", "chain", "ordereddict", "namedtuple",
)
#: Fixed value: steps for which a re-exported name is followed.
HOPS = 6
_VARIABLE = ("global_variable", "class_variable", "instance_variable")


def opaque(decorators) -> F.Column:
    """Whether a decorator may put something else in place of what it decorates."""
    return F.exists(F.coalesce(decorators, F.array().cast("array<string>")), lambda d: ~F.trim(F.substring_index(d, "(", 1)).isin(*TRANSPARENT))


def _index(symbols: DataFrame) -> DataFrame:
    """(target, tier, n, hit): exact qualified names, else the names that end in a target after a mark."""
    exact = symbols.select(F.col("qname").alias("target"), F.lit(0).alias("tier"), "sid")
    tails = symbols.select(F.explode(suffixes(F.col("qname"))).alias("target"), F.lit(1).alias("tier"), "sid")
    return _best(exact.unionByName(tails), ["target"], "sid")


def lookup(names: DataFrame, symbols: DataFrame, exports: DataFrame, scratch: Scratch, hops: int = HOPS) -> DataFrame:
    """(name, imported, sid, status, confidence, reason) of dotted names (name, imported).

    Exact, else the only definition that ends in the name (inferred), else ambiguous. Otherwise the longest prefix with one definition: if it is a
    module that re-exports the next part, the name it exports is looked up, for at most ``hops`` steps; if not, the prefix tells why there is no target.
    Imported names of which no part is known are external. symbols: (sid, qname, kind); exports: (module, name, target); of several the least target counts.
    """
    index = scratch.save(_index(symbols))
    one = index.where(F.col("n") == 1).join(symbols.select(F.col("sid").alias("hit"), "kind", "qname"), "hit")
    one = scratch.save(one.select(F.col("target").alias("prefix"), F.col("kind").alias("pkind"), F.col("qname").alias("pname")))
    ways = scratch.save(exports.groupBy(F.col("module").alias("pname"), F.col("name").alias("first")).agg(F.min("target").alias("to")))
    known = symbols.select(F.explode(F.split("qname", r"\.")).alias("top")).distinct().withColumn("known", F.lit(True))
    todo, out, k = names.select("name", "imported", F.col("name").alias("at"), F.col("imported").alias("by")).distinct(), None, 0
    while True:
        j = todo.join(index.withColumnRenamed("target", "at"), "at", "left")
        parts = F.split("at", r"\.")
        heads = j.where(F.col("n").isNull() & (F.size(parts) > 1)).select("name", "imported", "at", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("k"), F.array_join(F.slice(parts, 1, i), ".").alias("p")))).alias("x"))
        best = heads.select("name", "imported", "at", "x.k", F.col("x.p").alias("prefix")).join(one, "prefix").groupBy("name", "imported", "at").agg(F.max(F.struct("k", "pkind", "pname")).alias("b"))
        j = scratch.save(j.join(best.select("name", "imported", "at", "b.*"), ["name", "imported", "at"], "left").withColumn("rest", F.when(F.col("k").isNotNull(), F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), "."))).withColumn("first", F.split("rest", r"\.")[0]).withColumn("top", parts[0]))
        j = j.join(ways, ["pname", "first"], "left").join(known, "top", "left")
        tail = F.expr("substr(rest, length(first) + 1)")
        follow = F.coalesce((F.col("pkind") == "module") & F.col("to").isNotNull() & (F.concat("to", tail) != F.col("at")), F.lit(False)) & F.lit(k < hops)
        status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("pname").isNull() & F.col("by") & F.col("known").isNull(), "external").otherwise("unresolved")
        reason = (
            F.when((F.col("n") == 1) & (F.col("tier") == 1), "source root unknown")
            .when(F.col("n") == 1, "re-export" if k else "")
            .when(F.col("n") > 1, "several candidates")
            .when(F.col("pkind").isin(*_VARIABLE), "through a variable")
            .when(F.col("pname").isNotNull(), "no such member")
            .when(F.col("by") & F.col("known").isNull(), "outside the project")
            .otherwise("no definition")
        )
        done = j.where(F.col("n").isNotNull() | ~follow).select("name", "imported", F.when(F.col("n") == 1, F.col("hit")).alias("sid"), status.alias("status"), F.when((F.col("n") == 1) & (F.col("tier") == 0), "confirmed").otherwise("inferred").alias("confidence"), reason.alias("reason"))
        done = scratch.save(done)
        out = done if out is None else out.unionByName(done)
        todo = scratch.save(j.where(F.col("n").isNull() & follow).select("name", "imported", F.concat("to", tail).alias("at"), F.lit(True).alias("by")))
        k += 1
        if todo.isEmpty():
            return out


def linearize(bases: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, base, distance, way): each class of ``seeds`` (cls) and its bases in breadth-first order, which is that of (distance, way); itself at 0.

    bases: (cls, position, base). way holds the positions taken; of several ways to a base the first counts, and circles end where they close.
    """
    up = scratch.save(bases.select(F.col("cls").alias("base"), F.col("position").cast("int").alias("position"), F.col("base").alias("next")).distinct())
    layer = scratch.save(seeds.select("cls").distinct().select("cls", F.col("cls").alias("base"), F.lit(0).alias("distance"), F.array().cast("array<int>").alias("way")))
    out, k = layer, 0
    while True:
        k += 1
        step = layer.join(up, "base").select("cls", F.col("next").alias("base"), F.concat("way", F.array("position")).alias("way")).groupBy("cls", "base").agg(F.min("way").alias("way"))
        layer, n = scratch.save_counted(step.join(out.select("cls", "base"), ["cls", "base"], "left_anti").select("cls", "base", F.lit(k).alias("distance"), "way"))
        if not n:
            return out
        out = out.unionByName(layer)


def first_method(wanted: DataFrame, order: DataFrame, symbols: DataFrame) -> DataFrame:
    """(cls, attribute, skip, n, sid): the methods called ``attribute`` in the first class of the order that has one. wanted: (cls, attribute, skip); skip leaves out the class itself."""
    owner, last = F.regexp_extract("qname", r"^(.*)\.[^.]*$", 1), F.regexp_extract("qname", r"([^.]*)$", 1)
    methods = symbols.where(F.col("kind") == "method").groupBy(owner.alias("owner"), last.alias("attribute")).agg(F.count_distinct("sid").alias("n"), F.min("sid").alias("hit"))
    named = order.join(symbols.select(F.col("sid").alias("base"), F.col("qname").alias("owner")), "base")
    found = wanted.distinct().join(named, "cls").where(~F.col("skip") | (F.col("distance") > 0)).join(methods, ["owner", "attribute"])
    best = found.groupBy("cls", "attribute", "skip").agg(F.min(F.struct("distance", "way", "n", "hit")).alias("b"))
    return best.select("cls", "attribute", "skip", "b.n", F.when(F.col("b.n") == 1, F.col("b.hit")).alias("sid"))


def resolve_keys(refs: DataFrame, symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """refs (.., source, kind, key, a, b, name, position) with target_id, status, confidence and reason.

    symbols: (sid, qname, name, kind, decorators). Bases are resolved first; self, super and typed keys then look for the first class in breadth-first order of the
    bases that has the method (always inferred). Stars: the first module, in order of the imports, that defines or re-exports the name. Nested
    functions are inferred. A target behind a decorator that is not transparent is inferred, except as a base. Builtins are external.
    """
    scratch = Scratch(refs.sparkSession, "tiers")
    s = scratch.save(symbols.where(F.col("kind") != "local_variable").select("sid", "qname", "name", "kind", opaque(F.col("decorators")).alias("opaque")))
    refs = scratch.save(refs.withColumn("k", F.concat_ws("\u0001", "key", "a", "b")))
    keys = scratch.save(refs.where(~F.col("key").isin("builtin", "none")).select("k", "key", "a", "b").distinct())

    # stars become names: the first module that knows the head
    stars = keys.where(F.col("key") == "star").select("k", F.col("b").alias("dotted"), F.split("b", r"\.")[0].alias("head"), F.posexplode(F.split("a", ";")).alias("pos", "module"))
    modules = _index(s.where(F.col("kind") == "module")).where(F.col("n") == 1).join(s.select(F.col("sid").alias("hit"), F.col("qname").alias("m")), "hit").select(F.col("target").alias("module"), "m")
    stars = stars.join(modules, "module").withColumn("full", F.concat_ws(".", "m", "head"))
    ways = exports.groupBy(F.col("module").alias("m"), F.col("name").alias("head")).agg(F.min("target").alias("to"))
    stars = stars.join(s.select(F.col("qname").alias("full")).distinct().withColumn("defined", F.lit(True)), "full", "left").join(ways, ["m", "head"], "left")
    tail = F.expr("substr(dotted, length(head) + 1)")
    stars = stars.where(F.col("defined") | F.col("to").isNotNull()).groupBy("k").agg(F.min(F.struct("pos", F.when(F.col("defined"), F.concat_ws(".", "m", "dotted")).otherwise(F.concat("to", tail)).alias("name"), F.col("defined").isNull().alias("imported"))).alias("b"))
    plain = keys.where(F.col("key").isin("direct", "import", "nested")).select("k", F.col("a").alias("name"), (F.col("key") == "import").alias("imported"))
    typed = keys.where(F.col("key") == "typed").select("k", F.expr("ltrim('?', a)").alias("name"), F.col("a").startswith("?").alias("imported"))
    named = scratch.save(plain.unionByName(stars.select("k", "b.name", "b.imported")).unionByName(typed))
    found = scratch.save(named.join(lookup(named.select("name", "imported"), s, exports, scratch), ["name", "imported"]))

    # bases of classes, in order
    classes = s.where(F.col("kind") == "class").groupBy("qname").agg(F.min("sid").alias("cls"), F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).select(F.col("qname").alias("source"), "cls")
    inherit = refs.where(F.col("kind") == "inheritance").select("source", "k", "position").distinct().join(classes, "source").join(found.select("k", "sid", "status"), "k", "left")
    inherit = inherit.join(s.where(F.col("kind") == "class").select("sid", F.lit(True).alias("is_class")), "sid", "left")
    bases = scratch.save(inherit.select("cls", "position", F.when(F.col("is_class"), F.col("sid")).alias("base")))
    own = keys.where(F.col("key").isin("self", "super")).select("k", F.col("a").alias("source"), F.col("b").alias("attribute"), (F.col("key") == "super").alias("skip")).join(classes, "source", "left")
    of_type = keys.where(F.col("key") == "typed").select("k", F.col("b").alias("attribute")).join(found.select("k", "name", "sid", "status"), "k").join(s.select("sid", F.col("kind").alias("tkind")), "sid", "left")
    calls = scratch.save(own.select("k", "cls", "attribute", "skip", F.lit(False).alias("typed")).unionByName(of_type.where(F.col("tkind") == "class").select("k", F.col("sid").alias("cls"), "attribute", F.lit(False).alias("skip"), F.lit(True).alias("typed"))))
    order = scratch.save(linearize(bases.where(F.col("base").isNotNull()), calls.where(F.col("cls").isNotNull()).select("cls"), scratch))
    method = first_method(calls.where(F.col("cls").isNotNull()).select("cls", "attribute", "skip"), order, s)
    open_base = bases.where(F.col("base").isNull()).select(F.col("cls").alias("base")).distinct()
    lost = order.join(open_base, "base", "left_semi").select("cls").distinct().withColumn("lost", F.lit(True))
    calls = calls.join(method, ["cls", "attribute", "skip"], "left").join(lost, "cls", "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    reason = F.when(F.col("cls").isNull(), "class unknown").when(F.col("n") > 1, "several candidates").when(F.col("n") == 1, F.when(F.col("typed"), "inferred type").otherwise("along the bases")).when(F.col("lost"), "a base is unknown").otherwise("no such method")
    by_class = calls.select("k", "sid", status.alias("status"), F.lit("inferred").alias("confidence"), reason.alias("reason"))
    last = F.regexp_extract("name", r"([^.]*)$", 1)
    maybe_function = (F.col("status") == "external") & last.rlike("^[a-z]") & ~last.isin(*LOWERCASE_CLASSES)
    no_class = of_type.where(F.coalesce(F.col("tkind") != "class", F.lit(True))).select(
        "k", F.lit(None).cast("string").alias("sid"), F.when((F.col("status") == "external") & ~maybe_function, "external").otherwise("unresolved").alias("status"), F.lit("inferred").alias("confidence"),
        F.when(F.col("tkind").isin("function", "method") | maybe_function, "type of a function's result").when(F.col("status") == "external", "type outside the project").otherwise("type unknown").alias("reason"),
    )
    of_name = found.join(keys.where(F.col("key") == "typed").select("k"), "k", "left_anti").join(keys.where(F.col("key") == "nested").select("k", F.lit(True).alias("nested")), "k", "left")
    of_name = of_name.select("k", "sid", "status", F.when(F.col("nested"), "inferred").otherwise(F.col("confidence")).alias("confidence"), "reason")
    result = of_name.unionByName(by_class).unionByName(no_class).join(s.select("sid", "opaque"), "sid", "left")
    result = scratch.save(result.withColumnRenamed("sid", "target_id"))

    out = balanced_left_join(refs, result, "k", "line", scratch)
    status = F.when(F.col("key") == "builtin", "external").otherwise(F.coalesce("status", F.lit("unresolved")))
    reason = F.when(F.col("key") == "none", F.col("a")).when(F.col("key") == "builtin", "builtin").otherwise(F.coalesce("reason", F.lit("no star import knows the name")))
    sure = (F.col("confidence") == "confirmed") & (~F.coalesce("opaque", F.lit(False)) | (F.col("kind") == "inheritance"))
    return out.withColumn("reason", reason).withColumn("confidence", F.when(sure, "confirmed").otherwise("inferred")).withColumn("status", status).drop("k", "opaque")


# -- other languages ----------------------------------------------------------------------------------------------------


def go_methods(calls: DataFrame, methods: DataFrame, reach: DataFrame) -> DataFrame:
    """(call, target, status) of calls (call, file_id, name) whose receiver's type is unknown, by the method's name.

    Methods (sid, name, package) count if their package is the file's own or one it imports, reach: (file_id, package). One is inferred, several are
    ambiguous; a name that only other packages have is unresolved, one that none has external.
    """
    named = calls.select("file_id", "name").distinct()
    near = named.join(reach.distinct(), "file_id").join(methods, ["package", "name"]).groupBy("file_id", "name").agg(F.count_distinct("sid").alias("n"), F.min("sid").alias("hit"))
    anywhere = methods.select("name").distinct().withColumn("known", F.lit(True))
    found = named.join(near, ["file_id", "name"], "left").join(anywhere, "name", "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("known"), "unresolved").otherwise("external")
    return calls.join(found.select("file_id", "name", F.when(F.col("n") == 1, F.col("hit")).alias("target"), status.alias("status")), ["file_id", "name"]).select("call", "target", "status")


def by_usr(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call, target, status, confidence) of calls (call, usr, system, virtual): a definition before a declaration.

    Declared in a system header (system): external, or ambiguous if the project defines the same. Virtual calls are inferred, as an override may run.
    Several definitions are ambiguous; of declarations alone the least counts. symbols: (sid, usr, kind).
    """
    kinds = symbols.where(F.length("usr") > 0).groupBy("usr").agg(
        F.count_if(F.col("kind").isin("function", "method")).alias("n"), F.min(F.when(F.col("kind").isin("function", "method"), F.col("sid"))).alias("d"), F.min(F.when(F.col("kind").isin("function_declaration", "method_declaration"), F.col("sid"))).alias("p")
    )
    j = calls.join(kinds, "usr", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("system"), F.when(F.col("n") > 0, "ambiguous").otherwise("external")).when(F.col("n") > 1, "ambiguous").when((F.col("n") == 1) | F.col("p").isNotNull(), "resolved").otherwise("external")
    return j.withColumn("status", status).select("call", F.when(F.col("status") == "resolved", F.coalesce("d", "p")).alias("target"), "status", F.when((F.col("status") == "resolved") & ~F.col("virtual"), "confirmed").otherwise("inferred").alias("confidence"))


def by_global_name(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call, target, status) of calls (call, name) in a language with one namespace: symbols (sid, name). One match is inferred, several are ambiguous, none external."""
    n = symbols.groupBy("name").agg(F.count_distinct("sid").alias("n"), F.min("sid").alias("hit"))
    j = calls.join(n, "name", "left")
    return j.select("call", F.when(F.col("n") == 1, F.col("hit")).alias("target"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("external").alias("status"))


def slot_closure(links: DataFrame, slots: DataFrame, scratch: Scratch) -> DataFrame:
    """(slot, source): the places from which each slot (slot) can take its value, itself included. links: (slot, source) of direct transfers; circles end."""
    up = scratch.save(links.select(F.col("slot").alias("source"), F.col("source").alias("next")).distinct())
    layer = out = scratch.save(slots.select("slot").distinct().select("slot", F.col("slot").alias("source")))
    while True:
        step = layer.join(up, "source").select("slot", F.col("next").alias("source")).distinct()
        layer, n = scratch.save_counted(step.join(out, ["slot", "source"], "left_anti"))
        if not n:
            return out
        out = out.unionByName(layer)


def resolve_slots(calls: DataFrame, bindings: DataFrame, links: DataFrame, unknown: DataFrame) -> DataFrame:
    """(call, target, status, n) of calls through function pointers (call, slot).

    The functions bound to any slot in the closure are candidates, bindings: (slot, sid). One is inferred, unless a value that is no function also
    gets there (unknown: (slot)); then, and with several, it is ambiguous; with none unresolved.
    """
    scratch = Scratch(calls.sparkSession, "slots")
    reach = slot_closure(links, calls, scratch)
    found = reach.join(bindings.withColumnRenamed("slot", "source"), "source").groupBy("slot").agg(F.count_distinct("sid").alias("n"), F.min("sid").alias("hit"))
    foggy = reach.join(unknown.select(F.col("slot").alias("source")).distinct(), "source", "left_semi").select("slot").distinct().withColumn("fog", F.lit(True))
    j = calls.join(found, "slot", "left").join(foggy, "slot", "left")
    status = F.when(F.col("n").isNull(), "unresolved").when((F.col("n") == 1) & F.col("fog").isNull(), "resolved").otherwise("ambiguous")
    return j.withColumn("status", status).select("call", F.when(F.col("status") == "resolved", F.col("hit")).alias("target"), "status", F.coalesce("n", F.lit(0)).alias("n"))
