"""Problem 3: variant spellings of the names of companies and persons."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insumo.functions.text import plain
from insumo.llm.graph import components
from insumo.sources.shared import forget, saved

#: Sizes of the character n-grams; cosine from which two spellings are linked; average from which groups are joined, and
#: what a pair of spellings counts there that isn't linked.
GRAMS, LINKED, JOINED, UNLINKED = (3, 4, 5), 0.7, 0.55, 0.45
#: Letters of a word that a short form keeps.
SHORT = 4
# Fixed values (folded): words that tell nothing of who it is: legal forms, lines of business with their short forms, titles, particles.
LEGAL = r"ltda|me|epp|eireli|s ?a|sa|cia|mei|grupo|sr|sra|sr a|srs|matriz|filial(?: \d+)?|fil(?: \d+)?|inc|llc|corp"
BUSINESS = r"abras(?:ivos?)?|borr(?:ach(?:as?|arias?|aria))?|hidr(?:aul(?:ic[ao]s?)?)?|ferr(?:ag(?:em|ens)?|am(?:entas?|entaria)?|tas|amentas)?|rol(?:am(?:entos?)?)?|paraf(?:s|usos?)?|soldas?|gases|tubos?|con(?:ex(?:oes)?)?|mat(?:eriais|erial)?|eletr(?:icos?|ica)?|elet|m|ind(?:ustria|ustrial)?|metal(?:urgica)?|com(?:ercio|ercial)?|tintas?|dist(?:rib(?:uidor(?:a|es)?)?)?|equip(?:amentos?)?|eqptos?|prot(?:ecao)?|epis?|e|de|da|do|das|dos|a|o|s"
# Fixed values (folded): given names with their short forms and pet names.
GIVEN_NAMES = {"aparecida": "ap cida", "antonio": "ant toninho tonho", "benedito": "bene ben dito", "eduardo": "edu dudu", "fernanda": "fe fern nanda", "francisco": "fco chico kiko", "guilherme": "guilh gui", "jose": "j ze", "raimunda": "raim mundinha", "roberto": "rob beto", "sebastiao": "seb tiao", "terezinha": "ter tere tete teca", "joao": "", "maria": "", "ana": "", "paulo": "", "carlos": "", "luiz": "luis"}
GIVEN = "|".join(w for k, v in GIVEN_NAMES.items() for w in (k, *v.split()))
# Fixed values (folded): beginnings of the lines of business that tell one from another, and the line that they stand for; two words of one line are one.
LINES = {"abr": "abr", "bor": "bor", "hid": "hid", "fer": "fer", "rol": "rol", "par": "par", "sol": "sol", "gas": "sol", "tub": "tub", "con": "tub", "ele": "ele", "met": "met", "tin": "tin", "dis": "dis", "equ": "equ", "eqp": "equ", "epi": "equ", "pro": "equ"}
# Fixed values (folded): first words of places, as a branch is named after.
PLACES = r"serra|morro|ribeira|lagoa|santa|santo|sao|porto|campo|vila|nova|novo|praia|monte|rio|alto|jardim|parque|cidade|barra"


def _words_of(name: Column) -> Column:
    """A name between blanks: look-alike characters, accents and case folded, words run together with capitals parted, the branch left out."""
    x = F.lower(F.regexp_replace(plain(name), r"(?<=[a-z])(?=[A-Z])", " "))
    x = F.regexp_replace(x, rf"\s-\s*(?:{PLACES})\b[^-]*$", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " ")), F.lit(" "))


def core(name: Column) -> Column:
    """The words that tell most who a name means, sorted; NULL if there are none. Legal form, line of business, title and given name aren't among them."""
    x = F.regexp_replace(_words_of(name), rf"(?<= )(?:{LEGAL}|{BUSINESS}|{GIVEN})(?= )", "")
    words = F.filter(F.split(x, r"\s+"), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$"))
    return F.nullif(F.array_join(F.array_sort(words), " "), F.lit(""))


def spelling(name: Column) -> Column:
    """node, core, given, lines: a name's core with its given names (pet names as the name they stand for) and lines of business, sorted.
    Initials stand for any name. node is all three as one text; NULL without a core."""
    words = F.split(F.trim(_words_of(name)), " ")
    names = F.create_map(*(F.lit(x) for k, v in GIVEN_NAMES.items() for w in (k, *v.split()) if len(w) > 1 for x in (w, k)))
    lines = F.create_map(*(F.lit(x) for kv in LINES.items() for x in kv))
    given = F.array_sort(F.array_distinct(F.array_compact(F.transform(words, lambda w: F.try_element_at(names, w)))))
    of_line = F.filter(words, lambda w: w.rlike(rf"^(?:{BUSINESS})$"))
    line = F.array_sort(F.array_distinct(F.array_compact(F.transform(of_line, lambda w: F.try_element_at(lines, F.substring(w, 1, 3))))))
    c = core(name)
    return F.when(c.isNotNull(), F.struct(F.concat_ws("|", c, F.array_join(given, " "), F.array_join(line, " ")).alias("node"), c.alias("core"), given.alias("given"), line.alias("lines")))


def _forms(text: Column) -> Column:
    """A spelling and the short ones made of it: the first word cut (Dori Molele), and its start with the other's end (Dorilele).
    Either word may be the first."""
    w = F.split(text, " ")
    a, b = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    cut = lambda x, y: F.concat_ws(" ", F.array_sort(F.array(F.substring(x, 1, SHORT), y)))
    blend = lambda x, y: F.concat(F.substring(x, 1, SHORT), F.right(y, F.lit(SHORT)))
    two = (F.size(w) == 2) & (F.length(a) > SHORT) & (F.length(b) > SHORT)
    return F.array_distinct(F.when(two, F.array(text, cut(a, b), cut(b, a), blend(a, b), blend(b, a))).otherwise(F.array(text)))


def _grams(text: Column, sizes: tuple[int, ...] = GRAMS) -> Column:
    """The distinct character n-grams of each word, a shorter word as it is."""
    of = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n))))
    words = F.split(text, " ")
    each = F.flatten(F.transform(words, lambda w: F.flatten(F.array_compact(F.array(F.array(F.concat(F.lit("="), w)), *(of(w, n) for n in sizes))))))
    return F.array_distinct(F.transform(each, lambda g: F.xxhash64(g)))


def _vectors(names: DataFrame) -> DataFrame:
    """core, v, n2, own: the n-grams of each spelling, the rarest first, as numbers that hold the squared weight in their low 16 bits,
    the squared norm, and how many of the first no other spelling has. Arrays of plain numbers are intersected in compiled code,
    and the weights come along."""
    grams = names.select("core", F.explode(_grams(F.col("core"))).alias("g"))
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    weight = F.round(F.pow(F.log(F.col("n") / F.col("df")), 2) * 256).cast("long")
    total = names.agg((F.count("*") + 1).alias("n"))
    coded = df.crossJoin(F.broadcast(total)).select("g", "df", F.least(weight, F.lit(65535)).alias("w")).select("g", ((F.col("df") == 1) & (F.col("w") < 65535)).alias("own"), F.shiftleft("g", 16).bitwiseOR(F.col("w")).alias("code"))
    # the weight is in the code, so codes alone are shuffled; those of greatest weight, if it isn't cut, are of one spelling
    v = grams.join(coded, "g").groupBy("core").agg(F.collect_list("code").alias("v"), F.count_if("own").cast("int").alias("own"))
    v = v.select("core", "own", F.transform(F.array_sort(F.transform("v", lambda x: F.struct((-x.bitwiseAND(F.lit(65535))).alias("w"), x.alias("code")))), lambda x: x["code"]).alias("v"))
    return v.withColumn("n2", _norm2(F.col("v"))).filter("n2 > 0")


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(65535)))


def _postings(vectors: DataFrame, least: float) -> DataFrame:
    """A row for each n-gram of a vector's prefix that another vector has too: what is left behind the prefix has less than `least` times
    the norm. left: the squared weight from this n-gram on."""
    prefix = F.aggregate("v", F.struct(F.col("n2").alias("left"), F.lit(0).alias("n")), lambda s, x: F.when(s["left"] < least * least * F.col("n2"), s).otherwise(F.struct((s["left"] - x.bitwiseAND(F.lit(65535))).alias("left"), (s["n"] + 1).alias("n"))), lambda s: s["n"])
    shared = F.slice("v", F.col("own") + 1, F.greatest(F.lit(0), F.greatest(F.lit(1), prefix) - F.col("own")))
    each = vectors.select("core", "v", "n2", "own", F.posexplode(shared).alias("at", "g"))
    return each.select("core", "v", "n2", "g", (F.col("n2") - _norm2(F.slice("v", F.lit(1), F.col("own") + F.col("at")))).alias("left"))


def _shortened(text: Column) -> Column:
    """Hashes of what two texts at most two edits apart (one under ten letters, none under seven) have in common: the text without up to
    so many letters, as each edit drops one of either text. Of long texts two edits leave one of three pieces whole, at most two
    places off, so these are all pieces that a partner of any such length may have; between 31 and 32 letters are both."""
    n = F.length(text)
    without = lambda x, i: F.concat(F.substring(x, F.lit(1), i - 1), F.substr(x, i + 1))
    own = F.array(text)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: without(text, i))
    two = F.flatten(F.transform(one, lambda x, i: F.transform(F.sequence(i + 1, n - 1), lambda j: without(x, j))))
    third = lambda d: F.floor((n + d) / 3).cast("int")
    pieces = F.array(*(F.substring(text, third(d) * i + 1 + by, third(d)) for d in range(-2, 3) for i in range(3) for by in range(-2, 3)))
    forms = F.when(n < 7, own).when(n < 10, F.concat(own, one)).when(n <= 30, F.concat(own, one, two)).when(n <= 32, F.concat(own, one, two, pieces)).otherwise(pieces)
    # 40 bits are less to shuffle; equal ones of different forms only add a pair to check
    return F.array_distinct(F.transform(forms, lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << 40) - 1))))


def _slips(names: DataFrame) -> DataFrame:
    """a, b, cosine of spellings that share an n-gram of four letters or a word and are two slips apart without their blanks, in either
    order of the words: one under ten letters, none under seven.

    They are met by what slips leave of them, which hardly any other spelling has; a common n-gram of four letters brings none together."""
    # short numbers for the names, as each is shuffled with all of its forms; the lowest bit is kept free
    both = saved(names.select((F.monotonically_increasing_id() * 2).alias("h"), "core", F.replace("core", F.lit(" "), F.lit("")).alias("s"), F.array_join(F.reverse(F.split("core", " ")), "").alias("r")), "names")
    # the forms are many times the names, so that few partitions of names would be few long tasks
    spread = both.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    # the lowest bit of code: the words in reverse
    sides = spread.select(F.explode(F.when(F.col("s") == F.col("r"), F.array(F.struct(F.col("s").alias("t"), F.col("h").alias("code")))).otherwise(F.array(F.struct(F.col("s").alias("t"), F.col("h").alias("code")), F.struct(F.col("r").alias("t"), (F.col("h") + 1).alias("code"))))).alias("e"))
    forms = sides.select(F.col("e.code").alias("code"), F.explode(_shortened(F.col("e.t"))).alias("form"))
    reverse = F.col("x.code").bitwiseAND(F.col("y.code")).bitwiseAND(F.lit(1)) == 1
    bare = lambda c: F.col(c).bitwiseAND(F.lit(-2))
    met = forms.alias("x").join(forms.alias("y").hint("merge"), (F.col("x.form") == F.col("y.form")) & (F.col("x.code") < F.col("y.code")) & (bare("x.code") != bare("y.code")) & ~reverse).select(bare("x.code").alias("hx"), bare("y.code").alias("hy")).distinct()
    # by itself, so that the forms aren't on disk together with what else links need
    met = saved(met, "met", release=True)
    side = lambda c: both.select(F.col("h").alias(f"h{c}"), F.struct("core", "s", "r").alias(c))
    pairs = met.join(side("x"), "hx").join(side("y"), "hy")
    # the function gives -1 beyond its threshold
    orders = F.filter(F.array(*(F.levenshtein(x, y, 2) for x, y in (("x.s", "y.s"), ("x.s", "y.r"), ("x.r", "y.s")))), lambda e: e >= 0)
    shorter = F.least(F.length("x.s"), F.length("y.s"))
    near = pairs.withColumn("edits", F.array_min(orders)).filter(F.col("edits") <= F.when(shorter >= 10, 2).when(shorter >= 7, 1).otherwise(0))
    near = near.filter(F.arrays_overlap(_grams(F.col("x.core"), (4, 5)), _grams(F.col("y.core"), (4, 5))))
    return near.select(F.least("x.core", "y.core").alias("a"), F.greatest("x.core", "y.core").alias("b"), (1 - F.col("edits") / F.greatest(F.length("x.s"), F.length("y.s"))).alias("cosine"))


def links(names: DataFrame, least: float = LINKED) -> DataFrame:
    """a, b, cosine: pairs of different spellings (a < b) whose n-gram vectors have at least this cosine, or one of which is a short
    form of the other (the vector of that form, cosine 1). names: core, distinct.

    Weights are the inverse document frequency over all spellings. Only the rarest n-grams of each vector are joined on, as
    many as no pair of that cosine can do without (the rest of the vector is shorter than the threshold), so the join is
    complete and common n-grams are never expanded; the cosine itself is taken over whole vectors. All partners are kept.
    Two spellings have no more in common than either has from their first shared n-gram on, which is checked before.
    Spellings one or two slips apart are linked by an exact check of those that share an n-gram of four letters or more."""
    vectors = saved(_vectors(names), "vectors")
    x, y = _postings(vectors, least).alias("x"), _postings(vectors, least).alias("y")
    norms = F.sqrt(F.col("x.n2").cast("double") * F.col("y.n2"))
    cosine = _norm2(F.array_intersect("x.v", "y.v")) / norms
    ahead = F.least("x.left", "y.left") >= least * norms * (1 - 1e-9)
    near = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.core") < F.col("y.core")) & ahead).select(F.col("x.core").alias("a"), F.col("y.core").alias("b"), cosine.alias("cosine")).filter(F.col("cosine") >= least)
    forms = names.select(F.col("core").alias("of"), F.explode(_forms(F.col("core"))).alias("core")).filter("core <> of")
    short = forms.join(names, "core").select(F.least("core", "of").alias("a"), F.greatest("core", "of").alias("b"), F.lit(1.0).alias("cosine"))
    # slips cut the cosine of short words most: spellings a few letters apart are linked too
    return near.union(short).union(_slips(names)).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _joined(least: float, unlinked: float):
    """The rounds of average_linkage over the groups of one component: rows p, q, over, np, nq to rows party, into."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["p"], *rows["q"]})
        at = {x: i for i, x in enumerate(names)}
        size, over, into = {}, {i: {} for i in at.values()}, {}
        for p, q, o, n, m in zip(rows["p"].map(at), rows["q"].map(at), rows["over"], rows["np"], rows["nq"], strict=True):
            over[p][q] = over[q][p] = o
            size[p], size[q] = n, m
        avg = lambda p, q: unlinked + over[p][q] / (size[p] * size[q])
        # the best partner is on top, of equal ones the larger; entries that no longer hold are passed over
        heaps = {p: [(-avg(p, q), -q) for q in qs if avg(p, q) >= least] for p, qs in over.items()}
        for h in heaps.values():
            heapq.heapify(h)

        def best(p: int) -> int | None:
            h = heaps[p]
            while h and (-h[0][1] not in over[p] or avg(p, -h[0][1]) != -h[0][0]):
                heapq.heappop(h)
            return -h[0][1] if h else None

        while True:
            picks = {p: best(p) for p in over}
            pairs = [(q, p) for p, q in picks.items() if q is not None and q < p and picks[q] == p]
            if not pairs:
                break
            for q, p in pairs:
                for r, o in over.pop(p).items():
                    del over[r][p]
                    if r != q:
                        over[q][r] = over[r][q] = over[q].get(r, 0.0) + o
                size[q] += size[p]
                into[p] = q
            for q, _ in pairs:
                for r in over[q]:
                    if (a := avg(q, r)) >= least:
                        heapq.heappush(heaps[q], (-a, -r))
                        heapq.heappush(heaps[r], (-a, -q))
        found = []
        for p in into:
            q = into[p]
            while q in into:
                q = into[q]
            found.append((names[p], names[q]))
        return pd.DataFrame(found, columns=["party", "into"])

    return f


def average_linkage(clusters: DataFrame, edges: DataFrame, least: float = JOINED, unlinked: float = UNLINKED, rounds: int = 40) -> DataFrame:
    """core, party: groups joined by average linkage. clusters: core, party (the groups to begin with); edges: a, b, cosine.

    Each round, every group picks the group with the largest average cosine of their spellings (pairs without an edge count
    `unlinked`), and pairs of groups that pick each other are joined if it is at least `least`; joining such pairs at once
    gives the same as one by one. Rounds end when none is joined. Edges are summed by pairs of groups once; a round then adds up
    the sums of the groups it joined, and leaves out groups without a partner in reach, which get none later (an average of
    averages is never above both), so each is a few joins over what can still be joined. A hub with many variants takes in
    one a round: what is left to join after `rounds` goes through the same rounds, to their end, within each component of
    groups that can still be joined."""
    of = lambda edge, group: clusters.select(F.col("core").alias(edge), F.col("party").alias(group))
    sizes = clusters.groupBy("party").agg(F.count("*").alias("n"))
    sums = edges.join(of("a", "p"), "a").join(of("b", "q"), "b").filter("p <> q").groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.sum(F.col("cosine") - unlinked).alias("over"))
    sums = saved(sums.join(sizes.select(F.col("party").alias("p"), F.col("n").alias("np")), "p").join(sizes.select(F.col("party").alias("q"), F.col("n").alias("nq")), "q").select("p", "q", "over", "np", "nq"), "averages")
    avg = F.lit(unlinked) + F.col("over") / (F.col("np") * F.col("nq"))
    joined = []
    for _ in range(rounds):
        near = sums.filter(avg >= least).select("p", "q", avg.alias("avg"), "np", "nq")
        both = near.select("p", "q", "avg", F.col("np").alias("n")).union(near.select(F.col("q").alias("p"), F.col("p").alias("q"), "avg", F.col("nq").alias("n")))
        best = both.groupBy("p").agg(F.max(F.struct("avg", "q")).alias("best"), F.max("n").alias("n")).select("p", F.col("best.q").alias("q"), "n")
        mutual = F.col("r.q") == F.col("l.p")
        groups = best.alias("l").join(best.alias("r"), F.col("l.q") == F.col("r.p")).select(F.col("l.p").alias("party"), F.when(mutual, F.least("l.p", "l.q")).otherwise(F.col("l.p")).alias("into"), F.when(mutual, F.col("l.n") + F.col("r.n")).otherwise(F.col("l.n")).alias("n"))
        groups = saved(groups, "groups")
        if not groups.filter("party <> into").limit(1).count():
            forget(groups)
            break
        joined.append(groups)
        side = lambda g: groups.select(F.col("party").alias(g), F.struct(F.col("into").alias("g"), "n").alias(f"of_{g}"))  # noqa: B023, E731
        moved = sums.select("p", "q", "over").join(side("p"), "p").join(side("q"), "q").filter("of_p.g <> of_q.g").select(F.least("of_p", "of_q").alias("p"), F.greatest("of_p", "of_q").alias("q"), "over")
        new = saved(moved.groupBy(F.col("p.g").alias("p"), F.col("q.g").alias("q")).agg(F.sum("over").alias("over"), F.max("p.n").alias("np"), F.max("q.n").alias("nq")), "averages")
        forget(sums)
        sums = new
    else:
        label = components(sums.filter(avg >= least).select(F.col("p").alias("x"), F.col("q").alias("y")))
        within = sums.join(label.select(F.col("node").alias("p"), "label"), "p").join(label.select(F.col("node").alias("q"), "label"), ["q", "label"])
        joined.append(within.select("label", "p", "q", "over", "np", "nq").groupBy("label").applyInPandas(_joined(least, unlinked), "party string, into string"))
    moves = [j.filter("party <> into").select("party", "into") for j in joined]
    if not moves:
        forget(sums)
        return saved(clusters.select("core", "party"), "clusters")
    # a group goes into another once; that may go on, until the last
    last = saved(reduce(DataFrame.union, moves), "moves")
    forget(sums, *joined)
    while True:
        on = last.join(last.select(F.col("party").alias("into"), F.col("into").alias("up")), "into", "left")
        new = saved(on.select("party", F.coalesce("up", "into").alias("into"), F.col("up").isNotNull().alias("moved")), "moves")
        moved = new.filter("moved").limit(1).count()
        forget(last)
        last = new
        if not moved:
            break
    state = saved(clusters.join(last.select("party", "into"), "party", "left").select("core", F.coalesce("into", "party").alias("party")), "clusters")
    forget(last)
    return state


def parties(records: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, party) of records and of queries. records: id, name, a row for each name that a record bears; queries: id, name.

    Spellings of one record are one party to begin with, and so are records with an equal spelling. Cores are linked by links(); two
    spellings have the cosine of their cores (1 if equal), or 0 if both state given names, or both lines of business, and have
    none in common: Maria and Antonio of one surname stay apart, whoever else bears the surname alone. Names without a core mean
    nobody. Null names are left out; repeated rows count once."""
    named = lambda rows: saved(rows.select("id", F.explode(F.array_compact(F.array(spelling(F.col("name"))))).alias("s")).select("id", "s.*").distinct(), "named")
    known, asked = named(records), named(queries)
    nodes = saved(known.select("node", "core", "given", "lines").union(asked.select("node", "core", "given", "lines")).distinct(), "nodes")
    of_cores = links(nodes.select("core").distinct())
    side = lambda n: nodes.select(*(F.col(c).alias(f"{n}_{c}") for c in nodes.columns))
    apart = lambda c: (F.size(f"a_{c}") > 0) & (F.size(f"b_{c}") > 0) & ~F.arrays_overlap(f"a_{c}", f"b_{c}")
    linked = of_cores.join(side("a"), F.col("a") == F.col("a_core")).join(side("b"), F.col("b") == F.col("b_core")).select("a_node", "b_node", "a_given", "b_given", "a_lines", "b_lines", "cosine")
    equal = side("a").join(side("b"), (F.col("a_core") == F.col("b_core")) & (F.col("a_node") < F.col("b_node"))).select("a_node", "b_node", "a_given", "b_given", "a_lines", "b_lines", F.lit(1.0).alias("cosine"))
    cosine = F.when(apart("given") | apart("lines"), 0.0).otherwise(F.col("cosine"))
    edges = saved(linked.union(equal).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), cosine.alias("cosine")), "links")
    start = components(known.select(F.concat(F.lit("c:"), "node").alias("x"), F.concat(F.lit("r:"), "id").alias("y")))
    begun = start.filter("node like 'c:%'").select(F.substr("node", F.lit(3)).alias("core"), F.col("label").alias("party"))
    begun = nodes.select(F.col("node").alias("core")).join(begun, "core", "left").select("core", F.coalesce("party", F.concat(F.lit("c:"), "core")).alias("party"))
    state = average_linkage(begun, edges)
    party = lambda rows: rows.select("id", F.col("node").alias("core")).join(state, "core").select("id", "party").distinct()
    return party(known), party(asked)


def same_party_pairs(suppliers: DataFrame, offers: DataFrame) -> DataFrame:
    """key_a, key_b (key_a < key_b): supplier records of one party, and an offer (id, name) with every record of the party that its
    name means. The pairs of a party are the result asked for, whole."""
    aliases = suppliers.select("id", F.explode(F.from_json("aliases_json", "array<string>")).alias("name"))
    records = suppliers.select("id", "name").union(aliases)
    of_record, of_offer = parties(records, offers)
    of_record = saved(of_record, "record-parties")
    one = of_record.select(F.col("id").alias("a"), "party").join(of_record.select(F.col("id").alias("b"), "party"), "party").filter("a < b")
    two = of_offer.select(F.col("id").alias("a"), "party").join(of_record.select(F.col("id").alias("b"), "party"), "party")
    return one.union(two).select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
