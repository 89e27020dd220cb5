"""Text expressions: JVM-side where Spark has the means, Arrow batches where it has none (NFKC, spans, hashes)."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ticker and placeholder grammar that results depend on.
TICKER = r"^[.\-A-Za-z0-9]{1,20}\.[A-Za-z]{2,4}$"
PREFIX_TICKER = r"^([A-Za-z]{2,4})\.([.\-A-Za-z0-9]{1,20})$"
PREFIX_MARKETS = ("HK", "US", "SH", "SZ", "SG", "JP", "KR")
CASHTAG = r"\$([^$]{1,120})\$"
TRAILING = r"[\(（]\s*([.\-A-Za-z0-9]{1,20}\.[A-Za-z]{2,4})\s*[\)）]\s*$"
TAG = r"\$[A-Za-z0-9.]{1,12}\.(?:HK|US|SH|SZ|hk|us|sh|sz)\$"
PLACEHOLDER = r"\[[^\[\]]{1,12}\]|@\[用户\]|@[\p{L}\p{N}_]{1,30}|https?://\S+"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}\x{2B00}-\x{2BFF}\x{3030}\x{303D}]"
LETTERS = r"[一-鿿㐀-䶿぀-ヿ가-힣A-Za-z]"
# End of fixed values.


def normalized_ticker(raw: Column) -> Column:
    """SYMBOL.MARKET in capitals, also from MARKET.SYMBOL; null if it is neither."""
    t = F.trim(raw)
    market = F.upper(F.regexp_extract(t, PREFIX_TICKER, 1))
    swapped = F.upper(F.concat(F.regexp_extract(t, PREFIX_TICKER, 2), F.lit("."), market))
    return F.when(market.isin(*PREFIX_MARKETS), swapped).when(t.rlike(TICKER), F.upper(t))


def product_code(raw: Column) -> Column:
    """The four digits of a five-digit HK ticker."""
    return F.nullif(F.regexp_extract(normalized_ticker(raw), r"^0([1-9][0-9]{3})\.HK$", 1), F.lit(""))


def mention_code(raw: Column) -> Column:
    """HK digits without leading zeros; other markets as market:SYMBOL."""
    t = normalized_ticker(raw)
    symbol, market = F.regexp_extract(t, r"^(.*)\.([^.]+)$", 1), F.regexp_extract(t, r"^(.*)\.([^.]+)$", 2)
    bare = F.regexp_replace(symbol, "^0+", "")
    hk = F.when(symbol.rlike("^[0-9]+$"), F.when(bare == "", "0").otherwise(bare)).otherwise(symbol)
    return F.when(t.isNotNull(), F.when(market == "HK", hk).otherwise(F.concat(F.lower(market), F.lit(":"), symbol)))


def cashtags(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, ticker, raw_ticker (first seen), display_name, occurrences. Fields are read apart: a tag never spans two."""
    each = F.array(*[F.struct(F.lit(i).alias("field"), F.regexp_extract_all(F.coalesce(f, F.lit("")), F.lit(CASHTAG)).alias("inner")) for i, f in enumerate(fields)])
    found = rows.select(key, F.explode(each).alias("e")).select(key, F.col("e.field").alias("field"), F.posexplode("e.inner").alias("pos", "inner"))
    t = F.trim("inner")
    trailing = F.nullif(F.regexp_extract(t, TRAILING, 1), F.lit(""))
    raw = F.when(t.rlike(TICKER), t).otherwise(trailing)
    name = F.when(~t.rlike(TICKER) & trailing.isNotNull(), F.nullif(F.trim(F.regexp_replace(t, TRAILING, "")), F.lit("")))
    found = found.select(key, F.struct("field", "pos").alias("at"), raw.alias("raw"), name.alias("name")).withColumn("ticker", normalized_ticker(F.col("raw"))).where("ticker is not null")
    return found.groupBy(key, "ticker").agg(F.min_by("raw", "at").alias("raw_ticker"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("at"))).alias("display_name"), F.count(F.lit(1)).alias("occurrences"))


RICH_ITEM = "struct<type:int,text:string,emotion:struct<text:string>,user:struct<nick_name:string>,stock:struct<stock_code:string,market_type_label:string>,text_link:struct<text:string>>"


def rich_text(items: Column) -> Column:
    """Segments as one text: words, [emotion], @name, $code.MARKET$, link text."""

    def segment(x: Column) -> Column:
        blank = lambda c: F.coalesce(c, F.lit(""))
        code = blank(x["stock"]["stock_code"])
        return (
            F.when(x["type"] == 0, blank(x["text"]))
            .when(x["type"] == 1, F.concat(F.lit("["), blank(x["emotion"]["text"]), F.lit("]")))
            .when(x["type"] == 2, F.concat(F.lit("@"), blank(x["user"]["nick_name"])))
            .when(x["type"] == 3, F.when(code != "", F.concat(F.lit("$"), code, F.lit("."), F.upper(blank(x["stock"]["market_type_label"])), F.lit("$"))).otherwise(""))
            .when(x["type"] == 6, F.lit("[表情]"))
            .when(x["type"] == 7, blank(x["text_link"]["text"]))
            .otherwise("")
        )

    return F.nullif(F.trim(F.array_join(F.transform(items, segment), "")), F.lit(""))


def redacted(text: Column) -> Column:
    out = F.regexp_replace(text, r"https?://\S+", "[链接]")
    return F.regexp_replace(out, r"@[\p{L}\p{N}_]{1,30}", "@[用户]")


def sanitized_error(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 500)


def stripped_noise(text: Column) -> Column:
    for pattern in (TAG, PLACEHOLDER, EMOJI):
        text = F.regexp_replace(text, pattern, "")
    return text


def prefilter(rows: DataFrame, key: str, author: str, feed: str, text: str) -> DataFrame:
    """Add rule: empty, tag_only, sticker_only, exact_duplicate (not the first of author, post and text without blanks) or null."""
    t = F.col(text)
    empty, letters = t.isNull() | (F.trim(t) == ""), stripped_noise(t).rlike(LETTERS)
    early = F.when(empty, "empty").when(~letters, F.when(t.rlike(TAG), "tag_only").otherwise("sticker_only"))
    rows = rows.withColumn("_early", early)
    same = F.sha2(F.concat_ws("|", F.coalesce(author, F.lit("")), F.col(feed).cast("string"), F.lower(F.regexp_replace(t, r"\s+", ""))), 256)
    reached = F.col("_early").isNull() & (F.coalesce(author, F.lit("")) != "")
    rows = rows.withColumn("_same", F.when(reached, same))
    first = rows.where("_same is not null").groupBy("_same").agg(F.min(key).alias("_first"))
    rows = rows.join(first, "_same", "left")
    return rows.withColumn("rule", F.coalesce("_early", F.when(F.col("_first") != F.col(key), "exact_duplicate"))).drop("_early", "_same", "_first")


def nfkc(text: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return each(text)


SENTENCE_END = re.compile(r"[。！？!?；;\n]+|\.(?=\s|$)")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def sentence_spans(text: str | None) -> list[tuple[int, int, str]]:
    """Sentences with their place in the text; blank ones are left out."""
    if not text:
        return []
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    edges = [0, *ends, *([len(text)] if not ends or ends[-1] < len(text) else [])]
    return [(a, b, text[a:b].strip()) for a, b in zip(edges, edges[1:], strict=False) if text[a:b].strip()]


def sentences(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("start", "end", "text"), x, strict=True)) for x in sentence_spans(t)])

    return each(text)


def sentence_index(spans: Column, offset: Column) -> Column:
    """The sentence that holds an offset, else the last that begins before it, else -1."""
    inside = F.filter(F.transform(spans, lambda x, i: F.when((x["start"] <= offset) & (offset < x["end"]), i)), lambda x: x.isNotNull())
    before = F.size(F.filter(spans, lambda x: x["start"] <= offset)) - 1
    return F.when(offset.isNull(), -1).otherwise(F.coalesce(F.get(inside, F.lit(0)), before)).cast("int")


def fold_text(text: str | None) -> str:
    """What near-duplicate folding compares."""
    out = text or ""
    out = out if out.isascii() else unicodedata.normalize("NFKC", out)
    if "$" in out:
        out = _FOLD_TAG.sub("", out)
    if "[" in out or "@" in out or "://" in out:
        out = _FOLD_PLACES.sub("", out)
    return "".join(_FOLD_MARKS.sub("", out).split()).lower()


# What folding leaves out, in order; then blanks.
_FOLD_TAG = re.compile(TAG)
_FOLD_PLACES = re.compile(r"\[[^\[\]]{1,12}\]|@\[用户\]|@[\w一-鿿]{1,30}|https?://\S+|\[链接\]")
_FOLD_MARKS = re.compile(r"[，。！？、；：,.!?;:~～…—\-「」『』“”\"'（）()\[\]【】《》<>]")


@lru_cache(maxsize=200_000)
def pair_hash(pair: str) -> int:
    return int.from_bytes(hashlib.blake2b(pair.encode(errors="surrogatepass"), digest_size=8).digest(), "big")


def maximal_names(text: str, names: dict[str, str]) -> list[str]:
    """Codes of the names found, without those that only occur inside a longer name."""
    spans = sorted({(m.start(), m.start() + len(n), c) for n, c in names.items() if n for m in re.finditer(f"(?={re.escape(n)})", text)}, key=lambda s: (s[0], -s[1]))
    out: set[str] = set()
    widest: list[tuple[int, int]] = []
    for a, b, c in spans:
        i = bisect_right(widest, (a, 1 << 60)) - 1
        if not any(x <= a and b <= y and y - x > b - a for x, y in widest[: i + 1]):
            out.add(c)
        widest.append((a, b))
    return sorted(out)


LOCATED = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("method", T.StringType())])


def locate(text: str | None, quote: str | None) -> tuple[int | None, int | None, str | None]:
    """Place of a quote: exactly, or after NFKC, without blanks and case, mapped back to the text."""
    if not text or not quote:
        return None, None, None
    if (at := text.find(quote)) >= 0:
        return at, at + len(quote), "exact"
    flat, back = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).lower():
            if not x.isspace():
                flat.append(x)
                back.append(i)
    wanted = re.sub(r"\s+", "", unicodedata.normalize("NFKC", quote)).lower()
    at = "".join(flat).find(wanted) if wanted else -1
    return (back[at], back[at + len(wanted) - 1] + 1, "normalized") if at >= 0 else (None, None, None)


def located(text: Column, quote: Column) -> Column:
    @F.pandas_udf(LOCATED)
    def each(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([locate(a, b) for a, b in zip(t, q, strict=True)], columns=["start", "end", "method"]).astype({"start": "Int32", "end": "Int32"})

    return each(text, quote)


def script(text: Column) -> Column:
    """zh / en / other by which letters are most."""
    han = F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when((han == 0) & (latin == 0), "other").when(han >= latin, "zh").otherwise("en")


def short_name(name: Column, most: int = 8) -> Column:
    return F.substring(F.regexp_replace(name, r"\s*[\(（][^)）]*[\)）]\s*|\s+ETF$", ""), 1, most)


def lexicon_tags(text: Column, lexicon: dict[str, tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]]]) -> Column:
    """Classes that a text recalls: tag -> (mode, entity, action and rumor words), words as parts of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def held(words: tuple[str, ...]) -> Column:
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.lower(w))) if words else F.lit(False)

    rules = {"entity_or_action": lambda e, a, r: held(e) | held(a), "action": lambda e, a, r: held(a), "entity_and_rumor": lambda e, a, r: held(e) & held(r)}
    return F.array_compact(F.array(*[F.when(rules[mode](e, a, r), F.lit(tag)) for tag, (mode, e, a, r) in lexicon.items()]))


def offpool_only(rows: DataFrame, text: str, stocks: tuple[str, ...], product: tuple[str, ...]) -> DataFrame:
    """Add rule: offpool_stock_only where stocks are named, as whole Latin words, and nothing that refers to the product."""
    low = F.lower(text)
    named = low.rlike("(?<![a-z0-9])(?:" + "|".join(map(re.escape, stocks)) + ")(?![a-z0-9])")
    own = F.exists(F.array(*map(F.lit, product)), lambda w: F.contains(low, w))
    return rows.withColumn("rule", F.when(named & ~own, "offpool_stock_only"))


#: Traditional and simplified characters that product names are written with.
SIMPLER = (
    "數数 產产 槓杠 桿杆 備备 兌兑 認认 購购 權权 動动 紅红 時时 東东 選选 韓韩 現现 國国 業业 "
    "華华 滬沪 證证 創创 標标 經经 銀银 題题 陽阳 納纳 達达 頭头 偉伟 電电 亞亚 貨货 幣币 場场 "
    "債债 黃黄 億亿 與与 兩两 幾几 隻只 個个 對对 於于 機机 為为 變变 體体 邊边 積积 極极 "
    "價价 週周 藥药 織织 續续 買买 賣卖 錢钱 開开 關关 長长 節节 號号 點点 齊齐"
).split()


def attribution_form(text: Column) -> Column:
    """The form in which names are compared: NFKC, lower case, simplified characters."""
    return F.translate(F.lower(nfkc(text)), "".join(p[0] for p in SIMPLER), "".join(p[1] for p in SIMPLER))


def catalog_form(text: Column) -> Column:
    """A catalog's wording without case, blanks, signs and return kinds."""
    low = F.lower(nfkc(F.coalesce(text, F.lit(""))))
    low = F.regexp_replace(low, r"(?:net|gross|total)?\s*return|净总回报|總回報|净税|淨稅", "")
    return F.regexp_replace(low, r"[^0-9a-z\u3400-\u9fff]+", "")


#: Words by which an asset class or a focus tells the sector, in order.
SECTORS = (("asset", "virtual|crypto|虚拟|虛擬", "va"), ("asset", "bond|fixedincome|债|債", "fi"), ("asset", "commodity|gold|商品|黄金|黃金", "cm"), ("focus", "hongkong|香港", "hk"), ("focus", "china|中国|中國", "a"), ("focus", "unitedstates|美国|美國", "us"))


def sector_of(asset_class: Column, focus: Column) -> Column:
    form = {"asset": catalog_form(asset_class), "focus": catalog_form(focus)}
    return F.coalesce(*[F.when(form[on].rlike(words), F.lit(name)) for on, words, name in SECTORS], F.lit("apac"))


#: Wording of structures and directions, in order.
STRUCTS = (("covered call|備兌|备兑", "备兑高息"), ("leveraged|槓桿|杠杆|inverse|反向", "杠杆反向"), ("active|主動|主动", "主动 ETF"))
DIRECTIONS = (("反向|inverse|-1x|-2x", "inverse"), ("槓桿|杠杆|leveraged|2x", "leveraged"))


def struct_of(wording: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(wording).rlike(words), F.lit(name)) for words, name in STRUCTS], F.lit("ETF"))


def direction_of(wording: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(wording).rlike(words), F.lit(name)) for words, name in DIRECTIONS], F.lit("plain"))
