"""Chat windows, WARC derivatives and surrogates: round trips and edge cases."""

import gzip
import hashlib
import random
import re
import unicodedata
from collections import defaultdict

import duckdb
import regex
from pyspark.sql import functions as F

from tonearm.llm import chat, pii, warc
from tonearm.llm.common import Tables

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        lost = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(lost), sha(lost))
    return out


def test_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op6_chat(spark, SF).collect()}
    assert got == digests(rows)


def test_windows(spark):
    rng = random.Random(2)
    parts = ["</s>", "<s>", "<|", "|>", "\\", "[INST]", "[/INST]", "\n", "é", "word ", "<<SYS>>", "🎉", "|", "$1", "<|user|>\n"]
    text = lambda n: "".join(rng.choice(parts) for _ in range(rng.randrange(n)))
    rows = [(i % 6, i // 6, "system" if i < 6 else rng.choice(["user", "assistant", None, "a|b\\<|x|>"]), rng.choice([None, text(700)])) for i in range(150)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (7, 1, "user", "same"), (7, 1, "user", "same"), (8, 0, "assistant", "long " * 20_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, `window` int, loss int")
    made = chat.windows(df).cache()
    back, heads = defaultdict(lambda: ["", "", 0]), {}
    for r in chat.read_back(made).orderBy("conv_id", "window").collect():
        back[r.conv_id][0] += "".join(f"{t.role}\n{t.text}\n" for t in r.new)
        back[r.conv_id][1] += "".join(r.lost)
        back[r.conv_id][2] += len(r.new)
    assert {k: (n, sha(t), len(x), sha(x)) for k, (t, x, n) in back.items()} == digests(rows)
    longest = max(len(re.findall(r"\w+|[^\w\s]", t or "")) for c, _, _, t in rows if c != 8) + 4
    for r in made.collect():
        assert r.conv_id == 8 or r.n_tokens <= max(chat.BUDGET, longest)
        heads.setdefault(r.conv_id, []).append(r)
    for conv in range(6):
        windows = sorted(heads[conv], key=lambda r: r.window)
        assert windows[0].n_repeated == 0 and all(w.text.startswith("<|system|>") for w in windows)
        assert all(1 <= w.n_repeated <= 1 + chat.HISTORY_TURNS for w in windows[1:])
    assert chat.windows(df.limit(0)).count() == 0


def brute_windows(turns, budget, history):
    """(role, text, tokens) of one conversation to its windows: (repeated turns, new turns), by places."""
    out, system, end = {}, None, 0
    starts, last = [], None
    for i, (role, _, tokens) in enumerate(turns):
        start, end = end, end + tokens
        starts.append(start)
        if system is None and role == "system":
            system = i
        room = max(1, budget - history - (turns[system][2] if system is not None else 0))
        stretch = (end - 1) // room
        key = 2 * stretch + (0 if stretch != start // room else 1)
        if key != last:
            head = [system] if system is not None and i > system else []
            head += [j for j in range(max(0, i - chat.HISTORY_TURNS), i) if start - starts[j] <= history and j != system]
            out[key] = (head, [])
        out[key][1].append(i)
        last = key
    return list(out.values())


def test_windows_against_brute_force(spark):
    """Also with system turns that are not first, or several of them."""
    rng, rows = random.Random(4), []
    for conv in range(40):
        rows += [(conv, i, rng.choice(["user", "assistant", "user", "assistant", "system"]) if i else "user", f"t{conv}x{i} " + "w " * rng.randrange(60)) for i in range(rng.randrange(1, 40))]
    got = defaultdict(list)
    for r in chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200, 80).orderBy("conv_id", "window").collect():
        parts = [p.split(">\n", 1)[1] for p in r.text.split("</s>\n")[:-1]]
        got[r.conv_id].append((parts[: r.n_repeated], parts[r.n_repeated :], [r.text[s.start : s.end] for s in r.loss]))
    for conv in range(40):
        turns = [(role, text, len(re.findall(r"[^\W\d_]+|\d{1,3}", text)) + chat.OVERHEAD) for c, _, role, text in rows if c == conv]
        want = [([turns[i][1] for i in head], [turns[i][1] for i in new], [turns[i][1] for i in new if turns[i][0] == "assistant"]) for head, new in brute_windows(turns, 200, 80)]
        assert got[conv] == want


def test_warc_twin_and_links(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    result = con.execute(warc.ORACLE_SQL)
    names = [d[0] for d in result.description]
    df = warc.op5_warc(spark, SF)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())
    rows = df.collect()
    responses = {r.record_id: r for r in warc.responses(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    ids = {r.record_id: r for r in rows}
    for r in rows:
        source = responses[r.refers_to]
        assert (r.target_uri, r.source_digest) == (source.target_uri, source.payload_digest)
        assert ids[r.concurrent_to].concurrent_to == r.record_id and r.content_length == len(r.block.encode())
        assert r.block_digest == f"sha256:{sha(r.block)}"


PAGE = """<html lang='x'><title> A &amp;
 b&#8217;</title><p>a &amp;lt; b<br/>c <b>d</b> <script>x<y</script>e
 f<!-- <p> --> g</p><p> </p>h &#x27;&eacute;&nope; &#150; &#0; &nbsp; z & y &#xD800; &NotEqualTilde; <pre>q</pre>x<header >y</header><p-x>w"""


def test_warc_text_twin_on_odd_pages(spark):
    text = "A & b’\na &lt; b\nc d e f g\nh 'é&nope; – � z & y � ≂̸\nq\nx\ny\nw"
    rows = [(1, None, None), (2, "u\r\nEvil: x", ""), (3, "u", PAGE), (4, "v", "<p>" + "x " * 50_000), (5, "u", PAGE)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    result = con.execute(warc.ORACLE_SQL)
    names = [d[0] for d in result.description]
    df = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = sorted(map(tuple, df.select(*names).collect()))
    assert got == sorted(result.fetchall())
    blocks = {(r[0], r[1]): r[-1] for r in got}
    assert blocks[3, "conversion"] == text and len(blocks[4, "conversion"]) == 99_999 and blocks[1, "conversion"] == ""
    assert "title: A & b’\r\nlanguage: x\r\n" in blocks[3, "metadata"]


def parsed(data):
    """Records of WARC 1.1 bytes, told apart by their lengths alone."""
    out = []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(fields["Content-Length"])
        assert data[n : n + 4] == b"\r\n\r\n"
        out.append((fields, data[:n]))
        data = data[n + 4 :]
    return out


def test_warc_files(spark, tmp_path):
    """Every record of plain and of compressed files read back, by its lengths and by the library; ids are unique."""
    pages = spark.createDataFrame([(1, None, None, "q"), (2, "u\r\nEvil: x", "", "q"), (3, "u", PAGE, "q"), (4, "u", PAGE, "q"), (None, "u", PAGE, "q")], "page_id long, url string, html string, block string")
    derived = warc.derive(warc.responses(pages))
    assert derived.count() == 10 and warc.derive(warc.responses(pages.limit(0))).count() == 0
    same = pages.filter("page_id = 3").union(pages.filter("page_id = 3")).withColumn("n", F.monotonically_increasing_id())
    assert warc.derive(warc.responses(same)).select("record_id").distinct().count() == 2
    assert warc.derive(warc.responses(same, number="n")).select("record_id").distinct().count() == 4
    want = sorted((r.record_id, r.refers_to, r.concurrent_to, r.target_uri, r.block_digest, r.block.encode()) for r in derived.collect())
    assert len({w[0] for w in want}) == 10
    for compress in (False, True):
        folder = tmp_path / f"w{compress}"
        warc.write(derived, str(folder), compress)
        found = []
        for f in folder.glob("part-*"):
            data = f.read_bytes()
            found += parsed(gzip.decompress(data) if compress else data)
            if compress:
                assert data.count(bytes.fromhex("1f8b08")) == 2 * len(parsed(gzip.decompress(data)))
                f.rename(f.with_suffix(".gz"))
        names = ("WARC-Record-ID", "WARC-Refers-To", "WARC-Concurrent-To", "WARC-Target-URI", "WARC-Block-Digest")
        assert sorted((*[x[n] for n in names], block) for x, block in found) == want
        assert {"sha256:" + hashlib.sha256(b).hexdigest() for _, b in found} == {x["WARC-Block-Digest"] for x, _ in found}
        back = warc.read(spark, f"{folder}/*.gz" if compress else str(folder)).collect()
        assert all(r.whole for r in back)
        assert sorted((*[r.fields[n.lower()] for n in names], bytes(r.block)) for r in back) == want


def test_warc_responses_keep_their_source(spark, tmp_path):
    """Response records of a file: their ids, dates and HTTP headers stay with what is derived."""
    def record(n, body, length=None):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nServer: s{n}\r\nX-A: b: c\r\n\r\n{body}".encode()
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Date: 2020-01-0{n}T00:00:00Z\r\nWARC-Target-URI: http://x/{n}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {length or len(http)}\r\n\r\n"
        return head.encode() + http + b"\r\n\r\n"

    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    records = [info, record(1, "<p>é one</p>\r\n\r\nx"), record(2, ""), record(3, "cut", 999)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = warc.read_responses(spark, str(tmp_path), "1.0")
    rows = {r.record_id: r for r in got.collect()}
    assert rows.keys() == {"<urn:uuid:1>", "<urn:uuid:2>"} and rows["<urn:uuid:2>"].payload == ""
    one = rows["<urn:uuid:1>"]
    assert (one.target_uri, one.date, one.content_type, one.headers[1:]) == ("http://x/1", "2020-01-01T00:00:00Z", "text/html; charset=UTF-8", ["Server: s1", "X-A: b: c"])
    made = {(r.refers_to, r.warc_type): r for r in warc.derive(got).collect()}
    assert made["<urn:uuid:1>", "conversion"].block == "é one\nx" and made["<urn:uuid:1>", "conversion"].date == one.date
    assert "source-header: Server: s1\r\nsource-header: X-A: b: c\r\n" in made["<urn:uuid:1>", "metadata"].block


def warc_record(n, body, version="1.1", length=None, digest="", kind="text/html; charset=UTF-8"):
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + body
    extra = f"WARC-Payload-Digest: {digest}\r\n" if digest else ""
    head = f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{n}>\r\n{extra}Content-Length: {length or len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def test_warc_lengths_decide(spark, tmp_path):
    """Mixed versions, payloads that hold beginnings of records or whole records, records cut short amid others, in plain and compressed files."""
    inner = warc_record(99, b"inside")
    bodies = {1: b"one", 2: b"two \r\n\r\nWARC/1.1\r\nand more", 3: b"three" + b"\r\n\r\n" + inner + inner, 4: b"", 5: b"five \r\n\r\nWARC/", 7: b"seven"}
    records = [warc_record(n, b, "1.0" if n % 2 else "1.1") for n, b in bodies.items()]
    records.insert(5, warc_record(6, b"cut", length=9999))
    plain, packed, clean = tmp_path / "plain", tmp_path / "packed", tmp_path / "clean"
    for folder in (plain, packed, clean):
        folder.mkdir()
    (plain / "a.warc").write_bytes(b"".join(records))
    (plain / "b.warc").write_bytes(warc_record(20, b"other"))
    (packed / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (clean / "a.warc").write_bytes(warc_record(1, b"x", "1.0") + warc_record(2, b"y") + warc_record(3, b"z", "0.18"))
    got = {r.page_id: r.payload for r in warc.read_responses(spark, str(plain)).collect()}
    assert got == {f"<urn:uuid:{n}>": b.decode() for n, b in [*bodies.items(), (20, b"other")]}
    assert {r.page_id: r.payload for r in warc.read_responses(spark, str(packed)).collect()} == {f"<urn:uuid:{n}>": b.decode() for n, b in bodies.items()}
    assert [r.fields["warc-record-id"] for r in warc.read(spark, str(packed)).filter("not whole").collect()] == ["<urn:uuid:6>"]
    assert sorted(r.version for r in warc.read(spark, str(clean)).collect()) == ["0.18", "1.0", "1.1"]
    assert [r.page_id for r in warc.read_responses(spark, str(clean), "1.1").collect()] == ["<urn:uuid:2>"]


def test_warc_digests_and_charsets_of_the_source(spark, tmp_path):
    latin, broken = "<p>caf\xe9 \x80</p>".encode("latin-1"), b"<p>caf\xe9</p>"
    records = [warc_record(1, b"a", digest="sha1:ABC"), warc_record(2, latin, kind="text/html; charset=ISO-8859-1"), warc_record(3, broken)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    found = warc.read_responses(spark, str(tmp_path))
    rows = {r.page_id[10:-1]: r for r in found.collect()}
    assert rows["1"].payload_digest == "sha1:ABC"
    assert rows["2"].payload == "<p>café €</p>" and rows["2"].payload_digest == "sha256:" + hashlib.sha256(latin).hexdigest()
    assert rows["3"].payload == "<p>caf\ufffd</p>" and rows["3"].payload_digest == "sha256:" + hashlib.sha256(broken).hexdigest()
    derived = {(r.refers_to[10:-1], r.warc_type): r for r in warc.derive(found).collect()}
    assert derived["1", "metadata"].source_digest == "sha1:ABC" and "source-payload-digest: sha1:ABC" in derived["1", "metadata"].block
    assert derived["2", "conversion"].block == "café €"


SEEN = re.compile("|".join((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\w", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\b\d{13,19}\b")))


def test_surrogates_of_all_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r.text or "" for r in pii.op10_pii(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == texts.keys()
    known = {}
    for i, text in texts.items():
        old, new = SEEN.findall(text), SEEN.findall(got[i])
        assert len(old) == len(new) and not any(x in got[i] for x in old)
        assert all(known.setdefault(a, b) == b for a, b in zip(old, new, strict=True))
        if not old:
            assert got[i] == text
    assert known and len(set(known.values())) == len(known) and not known.keys() & set(known.values())


def luhn(digits):
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10


def test_surrogate_formats(spark):
    text = "Herr Müller, Frau Müller, Mr. John Smith. Госпожа Иванова (212) 555-0100 +12125550100 4111 1111 1111 1111, 4111111111111111 Jo@A.com jo@a.com 123-45-6789 1.2.3.4."
    rows = [(1, text, "q"), (1, text, "q"), (2, None, "q"), (None, "", "q"), (3, "call (212) 555-0100 " + "x " * 50_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, value string")
    out = pii.replace(df, "key").collect()
    assert len(out) == 5 and [r.text for r in out if r.doc_id == 2] == [None]
    one, two = (r.text for r in out if r.doc_id == 1)
    assert one == two
    m = re.fullmatch(r"Herr (\w+), Frau (\w+), Mr\. (\w+) (\w+)\. Госпожа ([А-Я][а-я]+ова) (\(\d{3}\) \d{3}-\d{4}) \+1(\d{10}) (\d{4} \d{4} \d{4} \d{4}), (\d{16}) (\S+) (\S+) (\d{3}-\d{2}-\d{4}) (\S+)\.", one)
    assert m and m[1] == m[2] and re.sub(r"\D", "", m[6]) == m[7] and m[8].replace(" ", "") == m[9] and m[10].lower() == m[11]
    assert luhn(m[9]) == 0 and m[9][0] == "4" and m[6] in [r.text for r in out if r.doc_id == 3][0]
    assert pii.replace(df, "other").filter("doc_id = 1").first().text != one
    crowd = spark.createDataFrame([(i, f"Mr. {a}{b} met") for i, (a, b) in enumerate((a, b) for a in "BCDFGHJKLM" for b in "aeiou")], "doc_id long, text string")
    names = [r.text.split()[1] for r in pii.replace(crowd, "key").collect()]
    assert len(set(names)) == 50 and pii.replace(df.limit(0), "key").count() == 0


def test_letters_of_every_script(spark):
    """No letter of a mail address or a name is copied, whatever its script; national telephone numbers are found."""
    rows = [
        (1, "write to 王伟同李娜芳@example.com or דויד.כהן@example.com, иван.ёжиков@пример.рф, þórður@example.is"),
        (2, "Mr. Søren Łęcki met Frau Ağaoğlu-Żółw and Dr. Ὀδυσσεύς Παπαδόπουλος"),
        (3, "call 030 12345678 or 0171/1234567 or 06 12 34 56 78, on 01-02-2024, 0.12345678, 0 12345"),
        (4, "محمد.علي@example.com 김철수민@example.kr ひらがな@example.jp คนไทย@example.th"),
    ]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert [len(got[i].entities) for i in (1, 2, 3, 4)] == [4, 5, 3, 4]
    assert got[3].text.endswith(", on 01-02-2024, 0.12345678, 0 12345")
    scripts = lambda t: [unicodedata.name(c, "?").split()[0] for c in t if c.isalpha()]
    for i, text in rows:
        for e in got[i].entities:
            old = text[e.start : e.end]
            new = got[i].text[e.start : e.end] if len(text) == len(got[i].text) else ""
            assert len(text) == len(got[i].text) and old != new
            part = lambda x: x.split("@")[0]
            assert sum(a == b for a, b in zip(part(old), part(new), strict=True) if a.isalnum()) <= len(old) // 2
            assert [s for s in scripts(part(old))] == [s for s in scripts(part(new))]


def test_later_mentions_and_international_numbers(spark):
    """Names without their title are the same person's, and numbers of other countries are found in their grouping."""
    phones = ["+44 20 7946 0958", "+33 1 23 45 67 89", "+34 912 34 56 78", "+49 30 12345678", "+47 12 34 56 78", "+442079460958"]
    texts = ["Herr Schmidt kam. Dann ging Schmidt, SCHMIDT und Schmidts Hund; Schmidtke blieb.", "Dr Anna Weber met Bo. Anna's car, Weber-Haus, Anna said", "Mr Weber's dog; Weber left", *phones, "Bo met Anna"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    m = re.fullmatch(r"Herr (\w+) kam\. Dann ging (\w+), (\w+) und (\w+)s Hund; Schmidtke blieb\.", got[0])
    assert m and m[1] == m[2] == m[3].capitalize() == m[4] != "Schmidt" and m[3].isupper()
    m = re.fullmatch(r"Dr (\w+) (\w+) met Bo\. (\w+)'s car, (\w+)-Haus, (\w+) said", got[1])
    assert m and m[1] == m[3] == m[5] != "Anna" and m[2] == m[4] != "Weber"
    assert got[2] == f"Mr {m[2]}'s dog; {m[2]} left" and got[9] == "Bo met Anna"
    for i, old in enumerate(phones, 3):
        assert got[i] != old and got[i][:3] == old[:3] and re.sub(r"\d", "0", got[i]) == re.sub(r"\d", "0", old)
    assert got[3].replace(" ", "") == got[8]


def brute_entities(text):
    """(kind, start, end) of a text by a plain scan: the kinds' patterns, and names word by word after titles and then anywhere."""
    title, part = regex.compile(rf"\b(?:{pii.TITLES})\x20"), regex.compile(pii.PART)
    names = set()
    for m in title.finditer(text):
        at = m.end()
        while found := part.match(text, at):
            word = found[0]
            if len(word) > 1 and not regex.fullmatch(pii.TITLES, word):
                names.add(word.lower())
            at = found.end() + (len(word) == 1 and text[found.end() : found.end() + 1] == ".")
            if text[at : at + 1] != " ":
                break
            at += 1
            while p := regex.compile(rf"(?:{pii.PARTICLES})\x20").match(text, at):
                at = p.end()
            if regex.compile(rf"(?:{pii.ENDS})(?!\p{{L}})").match(text, at):
                break
    kinds = [(k, regex.compile(pii.PATTERNS[k])) for k in pii.PATTERNS if k != "name"]
    known = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?i:{'|'.join(sorted(names, key=lambda n: (-len(n), n)))})(?=s?(?![\p{{L}}\p{{N}}]))") if names else None
    direct, out, at = regex.compile(pii.PATTERNS["name"]), [], 0
    while at < len(text):
        found = next(((k, m) for k, pattern in kinds if (m := pattern.match(text, at))), None) or next((("name", m) for pattern in (direct, known) if pattern and (m := pattern.match(text, at))), None)
        if found:
            out.append((found[0], at, found[1].end()))
        at = found[1].end() if found else at + 1
    return out


def test_entities_against_a_plain_scan(spark):
    """All documents of the smallest table and odd ones: spans as a scan finds them, all else untouched, surrogates one to one."""
    odd = ["Mr. Jean-Luc Picard came. Yesterday Picard left", "Mr. John Quincy Adams; Adams. The End", "Mme A. B. Dupont de la Tour, Tour", "müller@example.de x", "Señora Ana María López de la Cruz. López", "Herr Dr. Schmidt Die Tür", "GB82WEST12345698765432 and DE89 3704 0044 0532 0130 00", None, ""]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 5000] + [(10**6 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, entities string")
    texts, values = dict(rows), {}
    for r in pii.replace(df, "key").collect():
        text = texts[r.doc_id] or ""
        want = brute_entities(text)
        assert [tuple(e) for e in r.entities] == want
        rest, at = r.text or "", 0
        gaps = [text[a:b] for a, b in zip([0] + [e for _, _, e in want], [s for _, s, _ in want] + [len(text)], strict=True)]
        for (kind, start, end), before, after in zip(want, gaps, gaps[1:], strict=False):
            assert rest.startswith(before, at)
            at += len(before)
            stop = at + end - start if kind not in ("name", "ip") else (rest.index(after, at) if after else len(rest))
            old = text[start:end].lower() if kind in ("name", "email") else regex.sub("[^0-9A-Za-z+]", "", text[start:end]) if kind != "ip" else text[start:end]
            new = rest[at:stop].lower() if kind in ("name", "email") else regex.sub("[^0-9A-Za-z+]", "", rest[at:stop]) if kind != "ip" else rest[at:stop]
            if kind == "phone":
                old, new = old.removeprefix("+1"), new.removeprefix("+1")
            assert values.setdefault((kind, old), new) == new != old
            at = stop
        assert rest[at:] == gaps[-1]
    for kind in pii.PATTERNS:
        pairs = {old: new for (k, old), new in values.items() if k == kind}
        assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())
    ibans = [new.upper() for (k, _), new in values.items() if k == "iban"]
    assert ibans and all(int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 for x in ibans)


def test_surrogates_never_run_out(spark):
    """More values than there are surrogates of their form: later turns lengthen them, and all stay distinct."""
    rows = [(i, "name", c) for i, c in enumerate("bcdfghjklmnpqrstvwxyz")] + [(100 + i, "ssn", f"{i}") for i in range(10)]
    mentions = spark.createDataFrame(rows, "id long, kind string, value string")
    got = pii.entities(mentions, "key", Tables(spark, "crowd")).collect()
    assert len(got) == len(rows) and len({(r.kind, r.new) for r in got} | {(r.kind, r.value) for r in got}) == 2 * len(rows)
