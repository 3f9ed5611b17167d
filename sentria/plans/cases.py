"""Cases of the segmenter's rules: own texts with the sentences that they hold, named by the rule that decides them.

Each line of ``RULES`` is: rule, language, sentences. Sentences are parted by `` ‖ ``, which stands for a blank, or by ``‖``, which
stands for nothing; ``⏎`` is a line feed.
"""

from __future__ import annotations

RULES = """
P0 en Signs such as ∯ and &ᓰ& stay as they are. ‖ So do these: ♬ and ☏.
P1 en First line without a mark⏎ ‖Second line without one
P1 en A line. ‖ With two parts.⏎ ‖And a line after it.
P2 en 1. Wash the pan ‖ 2. Dry the pan ‖ 3. Put it away
P3 en We met Dr. Okafor on Elm St. near the bridge. ‖ It rained.
P4 zh 公司叫 A.B. 电子，很有名。‖我们去过。
P5 en It weighs 3.75 kg and costs $1.20 today. ‖ That is cheap.
P5 en Version 2.0.1 came out. ‖ Nobody noticed.
P6 en Really?! ‖ Yes!! ‖ Well then.
P6 en Stop!!! ‖ Now go on.
P7 en The dam was closed in May.12 ‖ It stayed closed.
P7 en The cause is unknown.[3] ‖ Others disagree.
P8 en We left at 5 p.m. on Friday. ‖ They stayed.
P8 en At 7 a.m. Eastern Standard Time the bell rings. ‖ People wake.
B0 en She paused (it was late) and went on. ‖ Nobody spoke.
B1 en One idea.⏎ ‖Another idea.
B2 en He waited . . . and then he left. ‖ The end.
B2 en I thought... ‖ Then I slept.
B2 en It was, well... fine in the end. ‖ Good.
B3 en no mark ends this piece of text
B4 en This one ends. ‖ this part has no mark at its end
B5 en The !Kung live there. ‖ They travel.
B5 en She used Yahoo! for her mail. ‖ It worked.
B6 en "Come in. Sit down." ‖ He obeyed.
B6 en They said «never» and left. ‖ It was true.
B7 en What?? ‖ You heard me.
B8 en "Is it over?" she asked. ‖ Nobody knew.
B8 en "Wait!" he cried. ‖ She waited.
B9 en Read part (ii) and part (iv) again. ‖ Then rest.
B10 en Bring nuts, figs etc., and water. ‖ Go early.
B12 en Good. ‖ Better! ‖ Best?
B14 en He wrote it down. ‖ "Done."
B15 en The firm moved to Bern, Switzerland. ‖ Its staff followed.
B16 zh 他说：“走吧。”‖我们就走了。
B17 en Use dots sparingly... ‖ They tire the reader.
B18 en A text with hidden signs.​ ‖ And another one.
B19 ja 「行こう！」と彼は言った。‖彼女は笑った。
A1 en The co. paid approx. 40 workers. ‖ They were glad.
A2 en No such word as cow. ‖ The word ends here.
A3 en Adm. Brandt and Gov. Ortiz met. ‖ They argued.
A4 en Mr. Lund arrived. ‖ He sat down.
A5 en Prof. Adeyemi taught physics. ‖ I liked it.
A6 en See fig. 3 and vol. 12 for more. ‖ Both are long.
A6 en Turn to p. 90 now. ‖ Read on.
A7 en The road leads to Elm Ave. and on to the sea. ‖ It is long.
A8 en Flat no. 4 is empty. ‖ Flat no. 5 is not.
A10 en It lies near Oak Ave. ‖ The bus stops there.
A13 en The U.S. economy grew. ‖ Prices fell.
A13 en Use a tool, e.g. a saw. ‖ Cut slowly.
A13 en We study i.e. read a lot. ‖ It helps.
A14 en The shop opens at 9 a.m. daily. ‖ It closes at 8 p.m. sharp.
A15 en She flew to the U.S. ‖ Her brother stayed.
A16 en Sold by ACME CO. LONDON and others. ‖ It broke.
A17 en He called at 6 p.m. ‖ She was out.
A19 en It was Mary and I. ‖ We were late.
A20 de Das gilt z. B. für Äpfel. ‖ Birnen fehlen.
A20 de Er kam am 4. Juni an. ‖ Sie blieb.
A20 de Siehe Nr. 3 und Art. 4 dazu. ‖ Mehr steht dort.
A21 en Gen. Mbeki spoke first. ‖ Sen. Ruiz followed.
A22 en The book by J. K. Marsh sold well. ‖ It was short.
A22 en He met W. E. B. Stone there. ‖ They talked.
L1 en Choose one: ‖ a) red ‖ b) green ‖ c) blue
L2 en i) the roof ‖ ii) the wall ‖ iii) the floor
L3 en 1. Mix the flour ‖ 2. Add the milk ‖ 3. Bake it
L4 en 1) Sit ‖ 2) Stand ‖ 3) Walk
L5 en Tasks: ‖ 1. Sweep the yard. ‖ 2. Feed the hens.
L6 sk Stalo sa to 5. mája 1990. ‖ Potom prišiel rok 1991.
en en Hello there. ‖ How are you?
en_legal en_legal See Hall v. Reyes, 12 F.3d 40 (9th Cir. 1999). ‖ The court agreed.
en_legal en_legal Under 5 U.S.C. § 552 it is public. ‖ Nobody asked.
en_es_zh en_es_zh The Sr. Vega came. ‖ 他走了。‖Then we left.
es es El Dr. Ruiz vive en la av. central. ‖ Trabaja mucho.
es es ¿Vienes mañana? ‖ ¡Claro que sí! ‖ Hasta luego.
fr fr M. Durand est parti. ‖ Il reviendra.
fr fr Voir p. 12 du livre. ‖ C'est clair.
it it Il sig. Conti abita qui. ‖ Lavora a Roma.
it it Vedi pag. 12 del libro. ‖ È chiaro.
de de Dr. Vogel wohnt hier. ‖ Er ist alt.
nl nl Dat is bijv. een boom. ‖ Hij is groot.
nl nl Zie blz. 12 van het boek. ‖ Het is oud.
da da Det er bl.a. en hest. ‖ Den er stor.
pl pl To jest np. dom. ‖ Jest duży.
sk sk Je to napr. strom. ‖ Je vysoký.
bg bg Това е гр. София. ‖ Тя е голяма.
ru ru Он живёт на ул. Мира. ‖ Там тихо.
ru ru Это было в 1999 г. в Москве. ‖ Потом он уехал.
kk kk Бұл кітап 1990 ж. шықты. ‖ Ол қызық.
el el Αυτό είναι σπίτι. ‖ Τι είναι; ‖ Τίποτα.
hy hy Սա տուն է։ ‖ Այն մեծ է։
am am ይህ ቤት ነው። ‖ ትልቅ ነው።
hi hi यह घर है। ‖ क्या यह बड़ा है? ‖ हाँ।
mr mr हे घर आहे. ‖ ते मोठे आहे.
my my ဒါအိမ်ဖြစ်သည်။ ‖ ကြီးသည်။
ur ur یہ گھر ہے۔ ‖ کیا یہ بڑا ہے؟ ‖ ہاں۔
ar ar هذا بيت جميل. ‖ هل هو كبير؟ ‖ نعم هو كبير.
fa fa این خانه است. ‖ آیا بزرگ است؟ ‖ بله بزرگ است.
zh zh 今天下雨。‖我们在家！‖你呢？
ja ja 今日は雨だ。‖家にいる。‖どこへ行く？
tl tl Si Gng. Reyes ay dumating. ‖ Masaya siya.
"""

#: Rule, language, text, and the number of sentences by split mode: conservative, balanced, aggressive.
MODES = [
    ("B2", "en", "I waited... Then I left.", 1, 2, 2),
    ("B8", "en", "Wow! what a day it was.", 1, 1, 2),
    ("A6", "en", "We need plan no. Ask again later.", 1, 2, 2),
    ("A17", "en", "He called at 6 p.m. She was out.", 1, 2, 2),
    ("A15", "nl", "Hij werkt voor de E.U. Dat is ver.", 1, 1, 2),
    ("B12", "en", "One. Two. Three.", 3, 3, 3),
]

#: Rule, language, text, and whether more text could still move the last boundary.
WAITS = [
    ("K1", "en", "He moved to the U.S.", True),
    ("K1", "en", "We saw Dr.", True),
    ("K1", "en", "It is done.", False),
    ("K1", "en", "Is it done?", False),
    ("K1", "en", "It costs 5.", True),
    ("K1", "en", "No mark yet", True),
    ("K1", "en", "   ", False),
    ("K1", "zh", "今天下雨。", False),
    ("K1", "de", "Er kam am 4.", True),
]

#: Rule, language, text, and the places of the periods that end no sentence.
PERIODS = [
    ("A12", "en", "Dr. Li ran. He won.", [2]),
    ("A12", "en", "At 3.5 km we met Mr. Ode. We spoke.", [4, 19]),
    ("A12", "en", "Use it, e.g. at home.", [9, 11]),
    ("A12", "de", "Das ist z. B. gut. Ja.", [9, 12]),
    ("A12", "en", "", []),
]

#: Rule, document type, text, and the text as the cleaner leaves it.
CLEAN = [
    ("C1", "", "One line\\nand a second\\rand a third", "One line\rand a second\rand a third"),
    ("C2", "", "It was a warm \nday by the lake.", "It was a warm day by the lake."),
    ("C3", "", "A short\nis\nline.", "A shortis\rline."),
    ("C4", "", "One part.\n\nTwo parts.\n \nThree.", "One part.\rTwo parts.\rThree."),
    ("C5a", "", "First row.\nSecond row\n. Third", "First row.\rSecond row. Third"),
    ("C5b", "pdf", "Buy: \n• milk\n• bread for a sand-\nwich\nand salt", "Buy: \r• milk\r• bread for a sandwich and salt"),
    ("C6", "", "A <b class='x>y'>bold</b> word, 3 < 4 &lt;i&gt;here&lt;/i&gt;", "A bold word, 3 < 4 here"),
    ("C8", "", "Text {b^>1<b^}with {b^&gt;22&lt;b^}marks", "Text with marks"),
    ("C9", "", "``Yes'' and `no'", '"Yes" and \'no\''),
    ("C10", "", "Opening ........ 7\nClosing....12-13\nDone", "Opening \r\rClosing\r\rDone"),
    ("C11", "", "It ended.Then it began.See http://x.Org or me@y.Net.", "It ended. Then it began. See http://x.Org or me@y.Net."),
    ("C12", "", "Wait.......go /// on", "Wait go  on"),
    ("C13", "ja", "私は\n行く。\n・項目", "私は行く。\n・項目"),
]


def rules() -> list[tuple[int, str, str, str, list[str]]]:
    """(number, rule, language, text, sentences) of every case."""
    out = []
    for line in RULES.strip().split("\n"):
        rule, code, rest = line.split(" ", 2)
        text = rest.replace(" ‖ ", " ").replace("‖", "").replace("⏎", "\n")
        wanted = [s.replace("⏎", "\n").strip().strip("​").strip() for s in rest.split("‖")]
        out.append((len(out), rule, code, text, [w for w in wanted if w]))
    return out


#: Legal texts and their sentences.
LEGAL = [
    ("See Hall v. Reyes, 12 F.3d 40 (9th Cir. 1999). The court agreed.", ["See Hall v. Reyes, 12 F.3d 40 (9th Cir. 1999).", "The court agreed."]),
    ("Under 5 U.S.C. § 552 it is public. Nobody asked.", ["Under 5 U.S.C. § 552 it is public.", "Nobody asked."]),
    ("The claim fails under Art. 3 of the act. It was late.", ["The claim fails under Art. 3 of the act.", "It was late."]),
    ("Counsel cited Reyes, supra. The judge nodded.", ["Counsel cited Reyes, supra.", "The judge nodded."]),
]
#: What the general profile makes of them: the number of sentences, whether they are right, and the boundary F1.
LEGAL_GENERAL = [(2, 1, 1.0), (2, 1, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
