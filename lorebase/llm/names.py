"""Variant spellings of names: merge-and-rematch resolution.

Each name and alias becomes a set of folded tokens. Full spellings (two tokens or more) that match token by token (one
slip of the pen each, nicknames, abbreviations, any order) merge their records. A merged record has the union of its
spellings and initials, and with that richer profile the weak spellings (a family name with or without an initial, the
short form of an organisation) are looked up again; this goes on until no further merge occurs. A weak spelling only
merges where exactly one profile fits, so a shared family name links nobody.

What identifies a name is its rarest token: the number of spellings that hold a token, one a slip apart, or the frequent
word it abbreviates, is counted over all rows of the type. The rarest token of both spellings must be the same but for a
slip or a nickname; an abbreviation only ever stands for one of the more frequent tokens, and a token that is left over
is never the rarest. Blocks are deletion neighbourhoods of the rarest token alone. A token that d spellings hold is the
rarest of at most min(d, number of tokens as frequent) two-token spellings, so no block outgrows the square root of the
table, whatever a third of the rows share.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.llm.components import connected_components
from lorebase.session import cut

TYPES = ("Person", "Organisation")
FLOOR = 8  # tokens of fewer spellings count as equally rare: a name's own variants are about as many
NEAR = 2  # tokens up to this much more frequent than the rarest are rarest as well
COMMON_SHARE = 1 / 2_000  # share of a type's spellings from which a token may be what others abbreviate; bounds their number

TITLES = frozenset("mr mrs ms miss mx dr prof professor doctor sir madam herr frau sr sra mme mlle rev".split())
LEGAL = frozenset("the of and co company ltd limited llc inc gmbh pty plc corp corporation ag sa holding holdings".split())
# words that stand for a role or a relation and name nobody
ROLES = frozenset("my our her his their mum mom dad mother father boss manager coach gp doctor landlord neighbour neighbor office school head the team teacher colleague wife husband partner friend sister brother therapist".split())

# common English given names and their usual short forms
SHORT = {
    "abigail": "abby gail", "adelaide": "addie", "albert": "al bert bertie", "alexander": "alex sasha xander sandy al", "alexandra": "alex sandra sasha", "alfred": "alf alfie fred", "alice": "allie", "alison": "ali allie", "amanda": "mandy", "andrew": "andy drew",
    "angela": "angie", "anne": "annie nan nancy", "anthony": "tony ant", "antonia": "toni", "archibald": "archie", "arthur": "art artie", "augustus": "gus", "barbara": "barb babs", "barnaby": "barney", "bartholomew": "bart", "beatrice": "bea trixie", "benjamin": "ben benny",
    "bernard": "bernie", "bridget": "biddy bridie", "calvin": "cal", "cameron": "cam", "caroline": "carrie caro", "catherine": "cathy cat kate katie kitty", "cecilia": "cissy celia", "charles": "charlie chuck chas", "charlotte": "lottie charlie", "christina": "chris tina chrissy",
    "christopher": "chris kit topher", "clarence": "clare", "clifford": "cliff", "constance": "connie", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "desmond": "des", "dominic": "dom nick", "donald": "don donnie", "dorothy": "dot dolly dottie",
    "douglas": "doug", "edmund": "ed ned ted", "edward": "ed eddie ned ted teddy", "eleanor": "ellie nora nell", "elizabeth": "liz beth betty eliza lizzie bess lisa", "emily": "em emmy", "ernest": "ernie", "eugene": "gene", "evelyn": "evie", "florence": "flo flossie",
    "frances": "fran frankie", "francesca": "fran frankie chess", "francis": "frank fran", "franklin": "frank", "frederick": "fred freddie fritz", "gabriel": "gabe", "gabriella": "gabby ella gabi", "geoffrey": "geoff", "george": "georgie", "gerald": "gerry jerry", "gilbert": "gil bert",
    "gregory": "greg", "gwendolyn": "gwen", "harold": "harry hal", "harriet": "hattie", "helen": "nell nellie", "henrietta": "etta hattie hen", "henry": "harry hal hank", "herbert": "bert herb", "irene": "rene", "isaac": "ike zac", "isabella": "bella izzy isa", "jacob": "jake",
    "jacqueline": "jackie", "james": "jim jimmy jamie", "janet": "jan", "jeffrey": "jeff", "jennifer": "jen jenny", "jeremiah": "jerry jem", "jeremy": "jem jerry", "jessica": "jess jessie", "joanna": "jo joey", "jonathan": "jon jonny nathan", "joseph": "joe joey", "josephine": "jo josie posy",
    "joshua": "josh", "judith": "judy", "julia": "jules", "katherine": "kate kathy kitty kat katie kit kay", "kenneth": "ken kenny", "kimberly": "kim kimmy", "laurence": "larry laurie", "leonard": "len leo lenny", "leopold": "leo", "lillian": "lil lily", "louisa": "lou", "lucille": "lucy",
    "madeline": "maddie mads", "magdalene": "maggie lena", "margaret": "maggie peggy meg marge greta madge", "martha": "marty", "martin": "marty", "matthew": "matt matty", "maxwell": "max", "melissa": "mel missy", "michael": "mike mick", "millicent": "millie", "mitchell": "mitch",
    "montgomery": "monty", "natalie": "nat", "nathaniel": "nate nathan nat", "nicholas": "nick nicky", "oliver": "ollie", "olivia": "liv livvy ollie", "oswald": "oz", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "penelope": "penny nell", "peter": "pete",
    "philip": "phil pip", "prudence": "prue", "raymond": "ray", "rebecca": "becky bex becca", "reginald": "reg reggie", "richard": "rick dick richie", "robert": "rob bob bobby robbie bert", "roderick": "rod", "ronald": "ron ronnie", "rosemary": "rosie", "rudolph": "rudy", "russell": "russ",
    "samantha": "sam sammy", "samuel": "sam sammy", "sebastian": "seb", "sidney": "sid", "solomon": "sol", "stanley": "stan", "stephanie": "steph stevie", "stephen": "steve stevie", "stuart": "stu", "susan": "sue susie", "susannah": "sue susie sukie", "sylvester": "sly", "sylvia": "syl",
    "terence": "terry", "theodora": "thea dora", "theodore": "ted theo teddy", "theresa": "tess terry", "thomas": "tom tommy", "timothy": "tim timmy", "tobias": "toby", "ursula": "ulla", "valentine": "val", "veronica": "ronnie vera", "victor": "vic", "victoria": "vicky tori vic", "vincent": "vince vinny vin",
    "virginia": "ginny", "vivian": "viv", "walter": "walt wally", "wilfred": "wilf fred", "wilhelmina": "mina billie willa", "william": "will bill billy liam", "winifred": "winnie fred freda", "winston": "win", "yvonne": "vonnie", "zachary": "zach zak",
}
FORMAL: dict[str, frozenset[str]] = {}
for _name, _short in SHORT.items():
    for _form in (_name, *_short.split()):
        FORMAL[_form] = FORMAL.get(_form, frozenset()) | {_name}


def fold(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return plain.casefold()


def tokens(text: str, person: bool) -> list[str]:
    """Folded tokens of a spelling without titles, legal forms and punctuation; initials are tokens of one letter."""
    if person:
        found = re.findall(r"[^\W\d_]+", fold(text.replace("'", "").replace("’", "")))
        return [t for t in found if t not in TITLES] or found
    apart = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ]{2})", " ", text)
    found = re.findall(r"[^\W_]+", fold(apart.replace("'", "").replace("’", "")))
    return [t for t in found if t not in LEGAL]


def slip(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart (tokens of four letters or more)."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if min(n, m) < 4 or abs(n - m) > 1:
        return False
    if n > m:
        a, b, n, m = b, a, m, n
    i = next((k for k in range(n) if a[k] != b[k]), n)
    if n < m:
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def shortened(a: str, b: str) -> bool:
    """Whether the shorter token abbreviates the other: its beginning, or its first letter and at least two fifths of
    its letters in order."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2 or a[0] != b[0] or len(a) == len(b):
        return False
    if b.startswith(a):
        return True
    letters = iter(b)
    return 5 * len(a) >= 2 * len(b) and all(c in letters for c in a)


def close_token(a: str, b: str, person: bool) -> bool:
    """Whether two tokens are the same but for a slip or, for persons, a nickname."""
    return slip(a, b) or (person and bool(FORMAL.get(a, frozenset()) & FORMAL.get(b, frozenset())))


def same_token(a: str, b: str, person: bool) -> bool:
    return close_token(a, b, person) or (not person and shortened(a, b))


def covers(a: list[str], b: list[str], person: bool) -> bool:
    """Whether every token of a has its own match in b (augmenting paths)."""
    taken: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j, y in enumerate(b):
            if j not in seen and same_token(a[i], y, person):
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(a)))


def same_name(a: list[str], b: list[str], person: bool, rare_a: Iterable[str] | None = None, rare_b: Iterable[str] | None = None) -> bool:
    """Whether two full spellings (two tokens or more) name the same: a rarest token of each is the same but for a slip
    or a nickname, and every other token of the shorter spelling has its own match in the longer one."""
    if len(a) > len(b):
        a, b, rare_a, rare_b = b, a, rare_b, rare_a
    if len(a) < 2:
        return False
    for x in a if rare_a is None else rare_a:
        for y in b if rare_b is None else rare_b:
            if close_token(x, y, person):
                rest_a, rest_b = list(a), list(b)
                rest_a.remove(x)
                rest_b.remove(y)
                if covers(rest_a, rest_b, person):
                    return True
    return False


def variants(token: str) -> set[str]:
    """The token and what is left of it when one letter is dropped; tokens one slip apart share one of these."""
    return {token} | ({token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) >= 4 else set())


def proper(text: str, own: list[list[str]], person: bool) -> bool:
    """Whether an alias names somebody: it shares a token with the row's name, or is no role and written as a name."""
    mine = tokens(text, person)
    for name in own:
        for a in mine:
            if any(same_token(a, b, person) or (len(min(a, b, key=len)) == 1 and a[0] == b[0]) or (a[1:] == b or b[1:] == a) for b in name):
                return True
    return len([t for t in mine if len(t) > 1]) >= 2 and not set(fold(text).split()) & ROLES and text[:1].isupper()


SPELLINGS = "id long, kind string, is_name boolean, full array<string>, initials array<string>, login boolean, said string"


def _spellings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, kind, name, aliases in zip(batch["id"], batch["kind"], batch["name"], batch["aliases"], strict=True):
            person = kind == "Person"
            own = [tokens(name, person)] if name else []
            texts = [(name, True)] if name else []
            texts += [(a, False) for a in (aliases if aliases is not None else []) if a and proper(a, own, person)]
            for text, is_name in texts:
                found = tokens(text, person)
                full = sorted({t for t in found if len(t) > 1})
                if full:
                    login = person and len(found) == 1 and text.strip().islower() and " " not in text.strip()
                    # what a weak spelling must share with an alias to be the same: for organisations its legal form as well
                    said = sorted(found) if person else sorted(t for t in re.findall(r"[^\W_]+", fold(text)) if t not in ("the", "of", "and"))
                    rows.append((key, kind, is_name, full, sorted({t for t in found if len(t) == 1}), login, " ".join(said)))
        yield pd.DataFrame(rows, columns=["id", "kind", "is_name", "full", "initials", "login", "said"])


def spellings(df: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    rows = df.filter(F.col("entity_type").isin(list(types)) & F.col("id").isNotNull()).select("id", F.col("entity_type").alias("kind"), "name", "aliases")
    return rows.mapInPandas(_spellings, SPELLINGS)


def variants_of(token: str) -> Column:
    """variants() as a column expression."""
    cut_out = lambda i: F.concat(F.substring(F.col(token), F.lit(1), i - 1), F.substring(F.col(token), i + 1, F.length(token)))
    dropped = F.when(F.length(token) >= 4, F.transform(F.sequence(F.lit(1), F.length(token)), cut_out)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.col(token)), dropped))


@F.pandas_udf(T.LongType())
def abbreviated(token: pd.Series, common: pd.Series) -> pd.Series:
    """Frequency of the most frequent common token that a token abbreviates, 0 if none."""
    return pd.Series([max((c["n"] for c in own if len(c["token"]) > len(t) and shortened(t, c["token"])), default=0) for t, own in zip(token, common, strict=True)], dtype="int64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def forms(token: pd.Series) -> pd.Series:
    """A given name, and the formal names it may stand for."""
    return pd.Series([[t, *sorted(FORMAL.get(t, frozenset()) - {t})] for t in token])


def token_weights(names: DataFrame) -> DataFrame:
    """(kind, token, weight): in how many spellings a token occurs, itself, a slip apart, or as what it abbreviates.

    names: kind, full. Every aggregation is on a token or a piece of one and combined before the exchange; the list of
    common tokens to a first letter has at most tokens a spelling / COMMON_SHARE entries.
    """
    df = cut(names.select("kind", F.explode("full").alias("token")).groupBy("kind", "token").agg(F.count("*").alias("n")))
    keyed = df.select("kind", "token", "n", F.explode(variants_of("token")).alias("key"))
    most = keyed.groupBy("kind", "key").agg(F.max("n").alias("m"))
    near = keyed.join(most, ["kind", "key"]).groupBy("kind", "token").agg(F.max("m").alias("near"))
    total = names.groupBy("kind").agg(F.count("*").alias("total"))
    common = df.join(F.broadcast(total), "kind").filter((F.col("kind") != "Person") & (F.col("n") >= F.greatest(F.lit(2), F.col("total") * COMMON_SHARE)))
    letter = F.substring("token", 1, 1).alias("letter")
    common = common.groupBy("kind", letter).agg(F.collect_list(F.struct("token", "n")).alias("common"))
    # the common tokens are few by their share, so the small side of this join is bounded
    whole = df.withColumn("letter", letter).join(F.broadcast(common), ["kind", "letter"], "left")
    short = whole.filter("common IS NOT NULL").select("kind", "token", abbreviated("token", "common").alias("meant"))
    both = near.join(df, ["kind", "token"]).join(short, ["kind", "token"], "left")
    return both.select("kind", "token", F.greatest(F.lit(FLOOR), "n", "near", F.coalesce("meant", F.lit(0))).alias("weight"))


@F.pandas_udf(T.BooleanType())
def matching(a: pd.Series, b: pd.Series, rare_a: pd.Series, rare_b: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([same_name(list(x), list(y), k == "Person", list(r), list(s)) for x, y, r, s, k in zip(a, b, rare_a, rare_b, kind, strict=True)])


def candidates(names: DataFrame) -> DataFrame:
    """(na, nb), na < nb: spellings that share a deletion of one of their rarest tokens. names: name, kind, rare."""
    rare = names.select("name", "kind", F.explode("rare").alias("token"))
    people = rare.filter("kind = 'Person'").select("name", "kind", F.explode(forms("token")).alias("token"))
    keyed = people.unionByName(rare.filter("kind <> 'Person'")).select("name", F.explode(variants_of("token")).alias("key"), "kind")
    blocks = cut(keyed.select("name", F.xxhash64("kind", "key").alias("key")).distinct())
    a, b = blocks.alias("a"), blocks.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.name") < F.col("b.name")))
    return met.select(F.col("a.name").alias("na"), F.col("b.name").alias("nb")).distinct()


def full_links(full: DataFrame) -> DataFrame:
    """Links (src, dst) between rows whose full spellings match. full: id, kind, full (two tokens or more)."""
    names = cut(full.groupBy("kind", "full").agg(F.min("id").alias("rep")).withColumn("name", F.xxhash64("kind", "full")))
    shared = full.join(names, ["kind", "full"]).select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    tokens_ = names.select("kind", "name", F.explode("full").alias("token")).join(token_weights(names), ["kind", "token"])
    rarest = tokens_.groupBy("name").agg(F.min("weight").alias("least"), F.collect_list(F.struct("token", "weight")).alias("all"))
    rare = F.transform(F.filter("all", lambda t: t["weight"] <= NEAR * F.col("least")), lambda t: t["token"])
    look = cut(names.join(rarest.select("name", rare.alias("rare")), "name"))
    left, right = (look.select(F.col("name").alias(f"n{s}"), F.col("full").alias(f"f{s}"), F.col("rare").alias(f"w{s}"), F.col("rep").alias(f"r{s}"), F.col("kind").alias(f"k{s}")) for s in "ab")
    checked = candidates(look).join(left, "na").join(right, "nb").filter("ka = kb").filter(matching("fa", "fb", "wa", "wb", "ka"))
    return shared.union(checked.select(F.col("ra").alias("src"), F.col("rb").alias("dst"))).filter("src <> dst")


def _initials(token: str) -> str:
    return "".join(sorted({token[0], *(f[0] for f in FORMAL.get(token, ()))}))


PROFILES = "cluster long, kind string, spelling string, key string, letters string"


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each token of a spelling: its blocking keys and the initials the rest of the spelling allows beside it."""
    for batch in batches:
        rows = set()
        for cluster, kind, full, initials in zip(batch["cluster"], batch["kind"], batch["full"], batch["initials"], strict=True):
            for token in full:
                rest = "".join(_initials(t) for t in full if t != token) + "".join(initials)
                for key in variants(token):
                    rows.add((cluster, kind, token, key, "".join(sorted(set(rest)))))
        yield pd.DataFrame(list(rows), columns=["cluster", "kind", "spelling", "key", "letters"])


WEAK = "id long, kind string, family string, initial string, key string"


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Readings of a weak spelling: its token as family name with the initials; a login also as initial and family name."""
    for batch in batches:
        rows = set()
        for key, kind, full, initials, login in zip(batch["id"], batch["kind"], batch["full"], batch["initials"], batch["login"], strict=True):
            token = full[0]
            read = [(token, i) for i in initials] or [(token, "")]
            if login and len(token) > 4:
                read.append((token[1:], token[0]))
            rows |= {(key, kind, f, i, v) for f, i in read for v in variants(f)}
        yield pd.DataFrame(list(rows), columns=["id", "kind", "family", "initial", "key"])


@F.pandas_udf(T.BooleanType())
def one_slip(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([slip(x, y) for x, y in zip(a, b, strict=True)])


def weak_links(every: DataFrame, clusters: DataFrame, open_: DataFrame) -> DataFrame:
    """Links from weak rows to the one cluster that fits. open_: ids still without a cluster."""
    profile = every.join(clusters, "id").select("cluster", "kind", "full", "initials", "is_name", "said")
    known = profile.drop("said").mapInPandas(_profiles, PROFILES).distinct()
    weak = every.join(open_, "id").filter("is_name")
    reading = weak.select("id", "kind", "full", "initials", "login").mapInPandas(_readings, WEAK).distinct()
    # a key of thousands of clusters (a given name) cannot decide anything; only how many there are matters
    near = known.groupBy("kind", "key", "spelling", "letters").agg(F.min("cluster").alias("c1"), F.max("cluster").alias("c2"))
    met = reading.join(near, ["kind", "key"]).filter((F.col("initial") == "") | F.instr(F.col("letters"), F.col("initial")).cast("boolean"))
    met = met.filter(one_slip("family", "spelling")).withColumn("tier", F.when(F.col("family") == F.col("spelling"), 1).otherwise(2))
    # the very spelling among a cluster's weak aliases goes before all
    weak_alias = profile.filter(F.size("full") == 1).groupBy("kind", "said").agg(F.min("cluster").alias("c1"), F.max("cluster").alias("c2"))
    same = weak.select("id", "kind", "said").join(weak_alias, ["kind", "said"]).select("id", "c1", "c2", F.lit(0).alias("tier"))
    tiers = met.select("id", "c1", "c2", "tier").unionByName(same).groupBy("id", "tier").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2"))
    best = tiers.withColumn("t", F.min("tier").over(Window.partitionBy("id"))).filter("tier = t AND c1 = c2")
    return best.select(F.col("id").alias("src"), F.col("c1").alias("dst"))


def lone_links(every: DataFrame, open_: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links among weak rows of a family name that no cluster has: all, unless two initials speak for two people."""
    weak = every.join(open_, "id").filter("is_name AND NOT login").select("id", "kind", F.get("full", F.lit(0)).alias("family"), F.get("initials", F.lit(0)).alias("i"))
    taken = every.join(clusters, "id").select("kind", F.explode("full").alias("family")).distinct()
    alone = weak.join(taken, ["kind", "family"], "left_anti")
    groups = alone.groupBy("kind", "family").agg(F.min("id").alias("dst"), F.min("i").alias("a"), F.max("i").alias("b"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 AND (a IS NULL OR a = b)").select("kind", "family", "dst")
    return alone.join(groups, ["kind", "family"]).select(F.col("id").alias("src"), "dst").filter("src <> dst")


def resolved(df: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(id, cluster): rows of df that mean the same person or organisation have the same cluster, their smallest id.

    df: id (unique), name, entity_type, aliases. Rows of other types, or without any usable spelling, are left out; null and
    empty aliases count as none; equal rows and ties are no special case; an empty table gives no row.
    """
    every = cut(spellings(df, types))
    full = every.filter(F.size("full") > 1)
    has_full = full.select("id").distinct()
    links = [cut(full_links(full.select("id", "kind", "full")))]
    waiting = cut(every.select("id").distinct().join(has_full, "id", "left_anti"))
    placed = cut(has_full)
    while True:
        found = connected_components(reduce(DataFrame.union, links)).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
        clusters = cut(placed.join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")))
        more = cut(weak_links(every, clusters, waiting))
        if more.isEmpty():
            break
        links.append(more)
        placed = cut(placed.union(more.select("src")))
        waiting = cut(waiting.join(more.select(F.col("src").alias("id")), "id", "left_anti"))
    links.append(lone_links(every, waiting, clusters))
    final = connected_components(reduce(DataFrame.union, links)).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    return every.select("id").distinct().join(final, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
