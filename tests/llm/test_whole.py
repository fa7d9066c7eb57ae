"""Cases where an operator once did less than the whole job."""

from fleetlens.llm import html_text, near_dup, quotes, secrets


# --- pages ------------------------------------------------------------------------------------

def test_every_open_element_has_its_node():
    n = 2000
    page = '<a href="#">' + "".join(f'<div id="x"><i>t{i}' for i in range(n)) + "</i></div>" * (n - 1) + "<p>last</p></div></a>end"
    nodes = html_text.parse(page)
    assert [x.depth for x in nodes[:n + 1]] == list(range(n + 1))
    assert all(x.tokens == ["x"] and x.parts[0][1] == f"t{i}" for i, x in enumerate(nodes[1:n + 1]))
    last = nodes[-1]
    assert last.tag == "p" and last.parent == 1 and last.parts[0][1:] == ("last", False)
    assert nodes[0].parts[-1][1:] == ("end", False)
    rows = html_text.node_rows(nodes, {})
    assert len(rows) == n + 2 and all(html_text.decode(nodes, [0.1] * (n + 2), [2.0] * (n + 2)))


def test_links_beyond_the_depth_end():
    nodes = html_text.parse("<div>" * 600 + '<a href="#">link</a>text')
    assert [(t, link) for x in nodes for _, t, link in x.parts] == [("link", True), ("text", False)]


def page_text(page):
    nodes = html_text.parse(page)
    return html_text.joined_text(nodes, [True] * len(nodes))


def test_skipped_elements_without_end_tag():
    story = "<article><p>The story.</p></article>"
    for head in ("<head>", "<head><title>T</title><meta charset=x>", "<head><script>'</head><p>no</p>'</script><!-- <p> -->",
                 "<head><noscript><img src=x></noscript><title>T</title>", "<head><title>T</title></head>"):
        for body in ("", "<body>", "</html>"):
            assert page_text(f"<html>{head}\n{body}{story}</html>") == "The story."
        assert page_text(f"<html>{head}The <b>story.</b>") == "The story."
    for skipped in ("<datalist><option value=x>one<option value=y>two</datalist>", "<select><option>one<option>two</select>",
                    "<select><optgroup label=a><option>one<optgroup label=b><option>two</option></select>",
                    "<datalist><option>one</option><option>two</datalist>", "<nav><button>menu</nav>", "<div><select><option>one</div>",
                    "<svg><g><svg><text>no</text></svg></g><text>no</text></svg>", "<button><div>icon</div>menu</button>",
                    "<object><p>no</p></div></object>", "<button>menu", "<canvas>", "<video><source src=x>"):
        assert page_text(f"<body><p>Before.</p>{skipped}{story}<div>After <button>no</button>it.</div>") == "Before.\nThe story.\nAfter it.", skipped
    assert page_text(f"<p>Before.<script>no{story}") == "Before."
    assert page_text(f"<p>Before.<textarea>no{story}") == "Before."


# --- secrets ------------------------------------------------------------------------------------

def test_private_keys_are_masked_to_their_end(spark):
    line, short, begin, end = "MIIEpAIBAAKCAQEA" * 4, "Qk3fA9==", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = "\n".join([line] * 25 + [short])
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n"
    cases = [(f"a {begin}\n{body}\n{end} b", "a [R] b"), (f"a\r\n{begin}\r\n{headers}{body}\r\n{end}\r\nb", "a\r\n[R]\r\nb"),
             (f"a {begin} {body.replace(chr(10), ' ')} {end} b", "a [R] b"), (f'"{begin}\\n{line}\\n{short}\\n{end}\\n"', '"[R]\\n"'),
             (f"> {begin}\n> {line}\n> {short}\n> {end}\nb", "> [R]\nb"), (f"a {begin}\n{body}\n\nNow some text.", "a [R]\n\nNow some text."),
             (f"a {begin}\n{headers}{body}", "a [R]"), (f'"{begin}\\n{line}\\n{short}\\n", x', '"[R]\\n", x'),
             (f"{begin}\n{line}\n{begin}\n{line}\n{end}", "[R]\n[R]"), (f"{begin}\n{line}\n-----END PRIVATE KEY-----", "[R]\n-----END PRIVATE KEY-----"),
             (f"A file with {begin} holds a key.", "A file with [R] holds a key."), (f"{begin}\n{'-a' * 50_000}", "[R]\n" + "-a" * 50_000),
             (f"{begin}\n{'a-' * 50_000}\n{end}x", "[R]x"), (f"{begin}\n{(line + chr(10)) * 5000}", "[R]\n"), (f"{begin} " * 3000, "[R] " * 3000)]
    df = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df, "[R]").collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, i


# --- near-duplicates --------------------------------------------------------------------------------

def test_one_row_of_each_component_stays(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = ([(1, base, {"k": 1})] * 3 + [(1, base + " x", {}), (2, base, {})] + [(None, "of nobody at all here " + base[::-1], {})] * 50
            + [(None, "another group of nobody", {})] * 2 + [(None, base, {}), (7, "alone here and there", {}), (8, "", {}), (8, "", {}), (9, None, {})])
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc map<string,int>").repartition(5)
    out = near_dup.drop_near_duplicates(df)
    assert out.dtypes == df.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    first = [x for x in got if x[0] == 1]
    assert len(first) == 1 and first[0][1] in (base, base + " x")
    assert [x for x in got if x[0] != 1] == sorted(
        [(7, "alone here and there"), (8, ""), (8, ""), (9, None), (None, "another group of nobody"), (None, rows[10][1])], key=repr)


# --- conversations ------------------------------------------------------------------------------------

def test_repeated_sentences_do_not_outvote_the_quoted_message(spark):
    sig = "Best regards from the whole team of the service desk in town."
    own = "The disk of host seven is full again."
    texts = ["Welcome. " + sig, "Yes. No.", own + " " + sig, "Maybe. Yes.", "No. Fine. " + sig,
             f"> {own}\n> {sig}\nWhy?", f"> {own}\nWhat?\n> {sig}\nAnd this?", "> Yes. No.\nBoth?", "> Yes.\nSure?",
             f"> {sig}\nThanks.", "> Yes. Never said.\nHow?", "> Never said.\nx", "> Yes. No. Welcome.\ny"]
    rows = [(c, i, "u", t) for c in (1, 2) for i, t in enumerate(texts)]
    out = quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = {5: (2, 2), 6: (2, 2), 7: (1, 2), 8: (3, 1), 9: (4, 1), 10: (3, 1), 12: (0, 3)}
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_linked) for r in out if r.reply_to is not None} == {
        (c, t): v for c in (1, 2) for t, v in want.items()}


# --- pages of any length, with and without something to learn from ------------------------------------

def long_page(i, paragraphs, tag="article"):
    story = "".join(f"<p>Story {i} goes on with sentence number {k} of its long text.</p>" for k in range(paragraphs))
    return (f'<html><body><nav class="menu"><ul><li><a href="/">Home {i}</a></li><li><a href="/a">About</a></li></ul></nav>'
            f"<{tag}><h1>Title {i}</h1>{story}</{tag}><footer>Imprint {i}</footer></body></html>")


def story_text(i, paragraphs):
    return "\n".join([f"Title {i}", *(f"Story {i} goes on with sentence number {k} of its long text." for k in range(paragraphs))])


def test_tables_of_long_pages_only(spark):
    df = spark.createDataFrame([(i, "u", long_page(i, 400)) for i in range(20)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert len(long_page(0, 400)) > 20_000 and all(got[i] == story_text(i, 400) for i in range(20))


def test_pages_without_anything_to_learn_from(spark):
    df = spark.createDataFrame([(1, "u", long_page(1, 3, "div")), (2, "u", None), (3, "u", '<div class="cookie-box">We use<p>them</p></div><p>Text')],
                               "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract_text(df).collect()} == {1: story_text(1, 3), 2: "", 3: "Text"}


# --- columns with names that operators use inside ------------------------------------------------------

def test_columns_with_clashing_names_stay(spark):
    from fleetlens.llm import decontaminate
    names = "secret_spans _doc _doc_ _hash _hash_ _numbers numbers _row".split()
    rows = [(1, "my password = hunter2000 ok", *[f"{n}!" for n in names]), (1, "nothing", *names), (None, None, *names), (3, "", *names),
            (1, "nothing", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = secrets.redact(df, "[R]")
    assert out.dtypes == df.dtypes
    want = [(1, "my [R] ok", *[f"{n}!" for n in names]), *rows[1:]]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    found = secrets.find_secrets(df)
    assert found.columns == df.columns and found.dtypes[2][1].startswith("array")
    bench = spark.createDataFrame([(1, "nothing")], "item_id long, text string")
    left = decontaminate.without_contaminated(df, bench)
    assert left.dtypes == df.dtypes and left.count() == 3
    one = near_dup.drop_near_duplicates(df)
    assert one.dtypes == df.dtypes and one.count() == 4
