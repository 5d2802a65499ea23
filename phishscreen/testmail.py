"""A mail table derived from the driver's documents, pages, labels and events.

MAIL_SQL is one text for Spark and DuckDB: every document is the body of a message whose headers are picked by remainders
of its id, so that all rules fire somewhere and the same rows come out of both engines. No backslash, no lambda.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(modulus: int, values: list[str]) -> str:
    return "CASE d.doc_id % " + str(modulus) + "".join(f" WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


HOSTS = ["mail.example.com", "kjehuf.cn-dqsb.com", "ad4ch8896b.example.org", "jgdyyt.shop", "gmail.com", "news.amazon.co.jp", "a.b.co.jp", "fshmjx.com", "rakuten.co.jp", "pia.co.jp", "strtrk.top"]
NAMES = ["Amazon", "Paul Smith", "", "三井住友カード", "billing@other.example.net", "Rakuten Shop", "JAL‮", "News"]
LOCALS = ["info", "xx9efvig", "kjehuf", "hmxdag", "sales"]
SUBJECTS = ["Hello", "至急ご確認ください", "amazon order", "お​知らせ 利用停止 凍結", "Your netflix plan", "本人確認 e-tax 還付", "weekly‮ letter", "再認証 のお願い", "smbc notice", "Weekly letter"]
AUTHS = ["mx; spf=pass dkim=pass dmarc=pass", "mx; spf=fail dkim=none dmarc=fail", "mx; SPF = softfail", "", "mx; dkim=pass", "mx; dmarc=fail", "mx; spf=neutral dkim=fail"]
PATHS = ["<info@mail.example.com>", "kjehuf@kjehuf.cn-dqsb.com", "Bounce <b@bounce.other.net>", "mail@sub.pia.co.jp", ""]
REPLIES = ["help@reply.example.net", "a@b.co.jp", ""]
IDS = ["mail.example.com", "other.example.net>", "ID.CN-DQSB.com>", "pia.co.jp>", ""]
UNSUBS = ["<https://unsub.list.example.net/x>, <mailto:off@list.example.net>", "<mailto:off@mail.example.com>", "<http://pia.co.jp:8080/u>", ""]
HOPS = ["from mx.example.com by in.example.net", "from [172.30.157.21] (c-69-180-237-15.hsd1.ga.comcast.net [69.180.237.15]) by mx.example.org", "from p1.OCN.ne.jp (p1.ocn.ne.jp [1.2.3.4])", "by local.example.com with x"]
STATUS = ["No, score=0.1", "Yes, score=7.5 required=5", "yes score=x", ""]
LINKS = ['<a href="https://www.example.com/a">x</a>', '<a HREF = "http://zhengli.example.net/x?y">x</a><a href="http://user@amazon.co.jp:80/">y</a>', '<a href="http://1.2.3.4/x">z</a>', '<a href="https://xn--abc.example.cn/">p</a>', '<a href="http://аmazon.example/login">q</a>', ""]
HIDDEN = ['<span style="display:none">abcdefghij0123456789</span>', '<div style="font-size: 0">short text</div>', '<p style="color:red;opacity:0">QWERTYUIOP asdfghjkl</p>', ""]

MAIL_SQL = f"""
SELECT d.doc_id AS doc_id, concat('m', CAST(d.doc_id AS VARCHAR(20))) AS msg_key,
  CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 0 OR l.toxic = 1 THEN 'spam' ELSE 'ham' END AS label,
  e.ts AS received_at, concat('box', CAST(d.doc_id % 4 AS VARCHAR(20))) AS source_path,
  concat({_pick(21, NAMES)}, ' <', {_pick(5, LOCALS)}, '@', {_pick(11, HOSTS)}, '>') AS from_h,
  {_pick(19, SUBJECTS)} AS subject_h, {_pick(23, AUTHS)} AS auth_h, {_pick(12, PATHS)} AS return_path_h, {_pick(14, REPLIES)} AS reply_to_h,
  concat('<', CAST(d.doc_id AS VARCHAR(20)), '@', {_pick(25, IDS)}) AS message_id_h, {_pick(9, UNSUBS)} AS unsub_h, {_pick(16, HOPS)} AS received_h,
  {_pick(13, STATUS)} AS status_h, CASE WHEN d.doc_id % 17 = 3 THEN '******' ELSE '' END AS level_h,
  CASE WHEN d.doc_id % 6 = 1 OR d.doc_id % 31 = 7 THEN '' ELSE d.text END AS plain,
  CASE WHEN d.doc_id % 31 = 7 THEN '<p><br></p>' WHEN d.doc_id % 3 = 0 THEN '' ELSE concat({_pick(15, LINKS)}, {_pick(22, HIDDEN)}, p.html) END AS html
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id
LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
"""


def spread(table: DataFrame) -> DataFrame:
    """Scoring is a costly map: a table that is read in fewer tasks than there are cores is dealt out to all of them first. A large
    one is not, however few its files: it has enough tasks, and would be sorted and shuffled whole into a few parts."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def mail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("documents", "labels", "events", "pages")
    frames = {f"_{n}": spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    frames["_documents"] = spread(frames["_documents"])
    sql = MAIL_SQL
    for n in names:
        sql = sql.replace(f" {n} ", f" {{_{n}}} ").replace(f"FROM {n})", f"FROM {{_{n}}})")
    return spark.sql(sql, **frames)


def messages(view: DataFrame) -> DataFrame:
    """The view as a table of messages."""
    names = {"from": "from_h", "subject": "subject_h", "authentication-results": "auth_h", "return-path": "return_path_h", "reply-to": "reply_to_h", "message-id": "message_id_h", "list-unsubscribe": "unsub_h", "received": "received_h", "x-spam-status": "status_h", "x-spam-level": "level_h"}
    headers = F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.array(c))])
    body = lambda kind, c: F.struct(F.lit(kind).alias("content_type"), F.col(c).alias("body"))
    return view.select("msg_key", F.col("message_id_h").alias("header_message_id"), "source_path", "label", "received_at", F.lit(None).cast("string").alias("meta_subject"), F.lit(None).cast("string").alias("meta_author"), headers.alias("headers"), F.array(body("text/plain", "plain"), body("text/html", "html")).alias("bodies"), F.lit(None).cast("string").alias("parse_error"))
