"""Questions whose sentences open with names, and items that have no window to index."""

from keepwell.llm import templates as tp

MARBLES = "Anna has 12 red marbles. Anna buys 7 more marbles. Ben gives Anna 3 marbles. How many marbles has Anna now?"
OTHERS = "Lucy has 45 red marbles. Lucy buys 16 more marbles. Omar gives Lucy 8 marbles. How many marbles has Lucy now?"
UNLIKE = "Lucy has 45 red marbles. Omar lost his bag on 16 May. Why did Eve count them? Nobody there could tell."


def found(spark, docs, items):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: r for r in tp.judge_documents(df, bench).collect()}


def test_names_that_open_sentences(spark):
    filler = "some ordinary words come before it and more of them "
    got = found(spark, [MARBLES, OTHERS, filler + OTHERS + " " + filler, UNLIKE, filler * 3, "Omar ran. " + OTHERS], [MARBLES])
    assert [got[i]["items"] for i in range(6)] == [[0], [0], [0], [], [], [0]]
    assert got[0].changed_slots == 0 and got[1].changed_slots >= 3 and got[1].coverage == 1.0


def test_items_without_windows(spark):
    items = ["Compute 17 * 24 - 9.", "The Old Man And The Sea By Ernest Hemingway", "2 + 2", "小明有十二个红色的弹珠他又买了七个弹珠现在一共有多少个", "cat"]
    docs = ["First: compute 17 * 24 - 9, then rest", "compute 17 * 24 + 9", "I read The Old Man And The Sea By Ernest Hemingway twice",
            "The Old Man And The Cat By Ernest Hemingway", "2 + 2", "so 2 + 2 is four", "前言文字。小明有十二个红色的弹珠他又买了七个弹珠现在一共有多少个？后记",
            "前言文字和其他完全不同的一段话没有任何题目", "the cat sat", "Cat."]
    got = found(spark, docs, items)
    assert [got[i]["items"] for i in range(len(docs))] == [[0], [], [1], [], [2], [], [3], [], [], [4]]
