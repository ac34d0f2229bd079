import random

from tesserae.llm.stuffing import covered_tokens, is_stuffed, stuffed_pages

SENTENCES = "The parser was rewritten because it could not read the new files. We moved the cache into the reader so that restores stay fast. Please check the report before the next session starts. "
STUFFED = [
    "#freebackup #cheaptool #freebackup #freebackup #cheaptool #freebackup #cheaptool #cheaptool #freebackup #freebackup #cheaptool #freebackup",
    "cheap tool, free backup, cheap tool, best tool, free backup, cheap tool, best tool\ncheap tool\nfree backup\ncheap tool, best tool",
    "Best free tool for free tool users who need free tool. Get free tool now, free tool today, free tool online. Our free tool is the free tool that every free tool wants: free tool!",
    "https://a-b.example/free-1\nhttps://c-d.example/tool-2\nhttps://e-f.example/best-3\nhttps://g-h.example/tool-4\nhttps://i-j.example/x-5\n" * 2,
    "fr​ee backup FREE BACKUP fr33 b4ckup free backup FREE BACKUP fr33 b4ckup fr​ee backup free backup",
    "We moved the cache into the reader so that restores stay fast.\n" + "Backup Max - $12.99 SALE\nBackup Pro - $11.99 NEW\nBackup Max - $2.99 HOT\nBackup Lite - $4.99 SALE\n" * 4,
    "backup tool near Patchville\nbackup tool in Radiuston\nfree wedge for Matrixburg\nbackup tool in Lanetown\nfree wedge near Nodeton\nfree wedge in Gateville\n" * 2,
]
CLEAN = [
    None,
    "",
    "   \n ",
    "tool tool tool",
    SENTENCES * 3,
    "12:01:02 WARN sharp-probe retry node after 426 ms\n12:01:03 WARN sharp-probe retry node after 93 ms\n" * 10,
    "Error: cannot read\n" + "    at readNode (tree-walk.ts:10:3)\n    at readList (tree-list.ts:12:9)\n" * 8,
    "```\n" + "for (const a of b) { c.push(a); }\n" * 20 + "```\nThe loop above is what I meant to show you.",
    "src/a/read-node.ts\nsrc/a/read-list.ts\nsrc/b/walk-node.ts\nsrc/b/walk-list.ts\n" * 4,
    "* **reader** (class): It is the part that reads the files.\n* **writer** (class): It is the part that writes them to the disk.\n" * 3,
    "".join(f"[docs {i}](https://a-b.example/x-{i}): The page explains how the reader {w} the files of a session.\n" for i, w in enumerate(["opens", "sorts", "checks", "closes"])),
]


PROSE = [
    "Вчера мы долго обсуждали новый способ хранения данных, но так и не пришли к общему решению. Каждый предлагал что-то своё, и спор затянулся до вечера. Наконец руководитель попросил всех подготовить короткие записки к понедельнику.",
    "Eilen keskustelimme pitkään uudesta tavasta tallentaa tietoja, mutta emme päässeet yhteisymmärrykseen. Jokainen ehdotti jotain omaa, ja väittely jatkui iltaan asti. Lopulta johtaja pyysi kaikkia valmistelemaan lyhyet muistiot maanantaiksi.",
    "昨天我们讨论了新的数据存储方式，但是没有达成一致意见。每个人都提出了自己的建议，争论一直持续到晚上。最后，经理请大家在星期一之前准备一份简短的备忘录。之后我们就回家了。",
    "Wczoraj długo rozmawialiśmy o nowym sposobie przechowywania danych, ale nie doszliśmy do porozumienia. Każdy proponował coś własnego i spór trwał do wieczora.",
    "ناقشنا أمس طريقة جديدة لتخزين البيانات لكننا لم نصل إلى اتفاق. اقترح كل واحد منا شيئا مختلفا واستمر النقاش حتى المساء. ثم طلب المدير من الجميع كتابة مذكرة قصيرة قبل يوم الاثنين.",
    "\n".join(f"{i}. {a}. (20{10 + i}). {t}. Journal of {j}, {i + 3}({i}), {i * 17}-{i * 17 + 11}. https://doi.org/10.10{i}/{i * 937}" for i, (a, t, j) in enumerate([("Smith, J", "A study of table driven parsers for small languages", "Software"), ("Meyer, K", "On the repair of broken indexes in large archives", "Systems"), ("Okafor, L", "Why restores fail and what can be done about it", "Storage")], 1)),
    "checkpoint - a saved state of all files\nbranch - a line of checkpoints\nrestore - to bring files back\nblob - the bytes of one file, stored once\nsession - the time between opening and closing a workspace",
    "## 1.4.0\n- add support for nested folders\n- fix crash when a file is locked\n- fix wrong size in the summary\n## 1.3.2\n- update the parser\n- remove old options\n- fix crash on empty input",
]
OTHER_STUFFED = [
    "купить дешево инструмент, скачать бесплатно инструмент, купить дешево архив, скачать бесплатно архив, купить дешево инструмент, скачать бесплатно архив, купить дешево инструмент",
    "免费下载工具 便宜备份 免费下载工具 便宜备份 免费下载工具 最好的备份 免费下载工具 便宜备份 免费下载工具 便宜备份 最好的备份 免费下载工具",
    "Tags: cold wedge backup, dry binder download, rare manifest best, direct parcel backup, smooth terrace download, wide signal backup, double mirror download, hidden batch buy, main basin free, idle probe free",
]


def test_cover_equals_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        letters = rng.choice([2, 4, 9, 30])
        t = ["x" * (1 + n % 3) + chr(97 + n % 26) + str(n) for n in (rng.randrange(letters) for _ in range(rng.randrange(0, 40)))]
        least = rng.choice([1, 4, 7, 12])
        want = [False] * len(t)
        for n in range(1, len(t)):
            at = {}
            for i in range(len(t) - n + 1):
                at.setdefault(tuple(t[i : i + n]), []).append(i)
            for span, starts in at.items():
                if len(starts) > 1 and sum(map(len, span)) >= least:
                    for s in starts:
                        want[s : s + n] = [True] * n
        assert covered_tokens(t, least) == want


def test_cover_is_no_word_count():
    t = "the cat saw the dog and the cow saw the cat".split()
    twice = [t.count(w) > 1 for w in t]
    assert covered_tokens(t) == [w in (0, 1, 9, 10) or w in (2, 3, 8) for w in range(len(t))] != twice


def test_languages():
    assert [is_stuffed(t) for t in PROSE] == [False] * len(PROSE)
    assert [is_stuffed(t) for t in OTHER_STUFFED] == [True] * len(OTHER_STUFFED)


def test_long_page():
    assert is_stuffed("cheap tool, free backup, best tool, " * 30_000)
    assert not is_stuffed("".join(f"The reader number {i} opened its file and closed it {i * 7} times later on. " for i in range(20_000)))


def test_pages():
    assert [is_stuffed(t) for t in STUFFED] == [True] * len(STUFFED)
    assert [is_stuffed(t or "") for t in CLEAN] == [False] * len(CLEAN)


def test_table(spark):
    texts = STUFFED + CLEAN
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, STUFFED[0], "y")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in stuffed_pages(df, "doc_id", "text").collect()) == list(range(len(STUFFED)))
    assert stuffed_pages(df.limit(0), "doc_id", "text").count() == 0
