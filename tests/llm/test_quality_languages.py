"""Clean text of many languages is kept, random letters of their scripts are not. The sentences are the first article of the Universal Declaration of Human Rights."""

import random

import pytest

from brindle.llm import quality_rules as Q
from brindle.llm.tokens import ByteBpe, WordPieces

ARTICLE = {
    "en": 'All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.',
    "de": 'Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.',
    "fr": 'Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.',
    "es": 'Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.',
    "fi": 'Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä aina.',
    "tr": 'Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler her zaman ve her yerde.',
    "pl": 'Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.',
    "cs": 'Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství po celý svůj život.',
    "hu": 'Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek minden időben.',
    "vi": 'Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.',
    "yo": 'Gbogbo ènìyàn ni a bí ní òmìnira; iyì àti ẹ̀tọ́ kọ̀ọ̀kan sì dọ́gba. Wọ́n ní ẹ̀bùn láàkàyè àti ti ẹ̀rí-ọkàn, ó sì yẹ kí wọn ó máa hùwà sí ara wọn gẹ́gẹ́ bí ọmọ ìyá.',
    "sw": 'Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu kila siku na mahali popote pale duniani kote.',
    "id": 'Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.',
    "zu": 'Bonke abantu bazalwa bekhululekile belingana ngesithunzi nangamalungelo. Bahlanganiswe wumcabango nangunembeza futhi kufanele baphathane ngomoya wobunye njalo nje kuzo zonke izindawo emhlabeni wonke ngezikhathi zonke ngaphandle kokungabaza.',
    "is": 'Hver maður er borinn frjáls og jafn öðrum að virðingu og réttindum. Menn eru gæddir vitsmunum og samvisku, og ber þeim að breyta bróðurlega hverjum við annan alla tíð.',
    "la": 'Omnes homines liberi aequique dignitate atque iuribus nascuntur. Ratione conscientiaque praediti sunt et alii erga alios cum fraternitate se gerere debent semper et ubique terrarum.',
    "haw": 'Hānau kūʻokoʻa ʻia nā kānaka apau loa, a ua kau like ka hanohano a me nā pono kīvila ma luna o kākou pākahi. Ua kuʻu mai ka noʻonoʻo pono a me ka ʻike pono ma luna o kākou.',
    "ru": 'Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства всегда и везде.',
    "el": 'Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.',
    "ar": 'يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء في كل زمان ومكان من دون أي تمييز بينهم',
    "he": 'כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה בכל עת ובכל מקום ובכל שעה',
    "uk": 'Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства завжди і всюди.',
    "bg": 'Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство навсякъде и винаги.',
}
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz", "latin with diacritics": "abcdefghijklmnopqrstuvwxyzàáâãèéêìíòóôõùúýăđĩũơư", "diacritics alone": "àáâãäåæçèéêëìíîïñòóôõöùúûüý", "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "digits": "0123456789",
}


def kept(texts):
    return Q.judge([t.encode() for t in texts], WordPieces.shared(Q.VOCABULARY), Q.BANDS, ByteBpe.shared(Q.BYTE_VOCABULARY))["kept"]


@pytest.mark.parametrize("language", ARTICLE)
def test_clean_text_of_many_languages_is_kept(language):
    assert kept([ARTICLE[language]])[0]


@pytest.mark.parametrize("script", LETTERS)
def test_random_letters_are_rejected(script):
    rng = random.Random(script)
    texts = [" ".join("".join(rng.choice(LETTERS[script]) for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (80, 200, 1000)]
    assert not any(kept(texts))


def test_texts_without_words_and_mixed_batches():
    texts = ["", " ".join("12 345".split() * 100), ARTICLE["vi"], "*** " * 50, ARTICLE["yo"], ARTICLE["en"]]
    assert list(kept(texts)) == [False, False, True, False, True, True]
