"""Word lists of the text analytics, in alphabetical order."""

from __future__ import annotations

POSITIVE: dict[str, float] = {w: x for x, ws in {
    0.5: "nice useful",
    0.6: "advantageous beneficial charming effective efficient encouraging enjoyable favorable good helpful lovely motivating optimistic pleasant pleased positive promising refreshing satisfied valuable",
    0.7: "beautiful cheerful delightful excited grateful great happy impressive inspiring remarkable successful terrific thankful uplifting",
    0.8: "awesome brilliant fabulous fantastic incredible joyful marvelous superb thrilled wonderful",
    0.9: "amazing excellent exceptional magnificent outstanding perfect",
}.items() for w in ws.split()}

NEGATIVE: dict[str, float] = {w: x for x, ws in {
    0.3: "complex",
    0.4: "ambiguous challenging complicated uncertain unclear",
    0.5: "annoyed confusing difficult doubtful questionable",
    0.6: "bad broken damaged deficient disappointed faulty flawed frustrated gloomy inadequate insufficient irritated negative pessimistic poor problematic sad suspicious troublesome unhappy unreliable upset",
    0.7: "angry depressed disappointing offensive ruined unsatisfactory untrustworthy",
    0.8: "awful deplorable despicable destroyed detestable devastated dreadful furious miserable outraged repulsive revolting",
    0.9: "abysmal appalling atrocious disgusting horrible terrible",
}.items() for w in ws.split()}

INTENSIFIERS: dict[str, float] = {w: x for x, ws in {
    0.6: "hardly scarcely",
    0.7: "barely",
    0.8: "slightly",
    1.1: "moderately somewhat",
    1.2: "rather",
    1.3: "considerably quite",
    1.4: "highly really significantly substantially truly",
    1.5: "deeply entirely vastly very",
    1.6: "completely enormously immensely remarkably totally",
    1.7: "absolutely tremendously",
    1.8: "exceptionally incredibly",
    1.9: "extraordinarily",
    2.0: "extremely",
}.items() for w in ws.split()}

NEGATORS = """
absent against aren't can't cannot couldn't denied denies deny didn't doesn't don't hadn't hasn't haven't isn't lack lacking neither never no nobody
none nor not nothing nowhere oppose opposed opposes refuse refused refuses reject rejected rejects shouldn't wasn't weren't without won't wouldn't
""".split()

TOPIC_STOP = """
a about after all also an and any as at back be because but by can come could day do even first for from get give go good have he her him his how i if
in into it its just know like look make me most my new no not now of on one only or other our out over people say see she so some take than that the
their them then there these they think this time to two up us use want way we well what when which who will with work would year you your
""".split()

TOPICS: dict[str, list[str]] = {k: v.split() for k, v in {
    "Business": "brand business client commercial company competition corporate customer economy entrepreneur finance industry investment leadership management market marketing product profit revenue sales service startup strategy trade",
    "Education": "academic class college course curriculum degree education educational graduation knowledge learning lecture pedagogy research scholarship school skill student study teacher teaching thesis training university",
    "Entertainment": "actor actress album artist celebrity comedy concert culture director drama entertainment film gaming hollywood media movie music performance podcast producer show song streaming television theater video",
    "Environment": "biodiversity carbon change clean climate conservation ecology ecosystem emission energy environment environmental forest global green nature ocean pollution recycling renewable sustainability warming wildlife",
    "Finance": "asset bank banking budget capital credit debt economic economy finance financial fund insurance investment investor liability loan market money mortgage portfolio profit revenue stock tax trading",
    "Food": "breakfast chef coffee cooking cuisine delicious diet dinner dish drink flavor food fresh healthy ingredient kitchen lunch meal nutrition organic recipe restaurant taste vegan vegetarian wine",
    "Health": "clinic diagnosis diet disease doctor exercise fitness health healthcare hospital illness medical medicine mental nutrition patient pharmaceutical physical prevention surgery symptoms therapy treatment wellness",
    "Politics": "administration candidate congress conservative democracy democrat election government governor law legislation liberal mayor minister parliament policy political politics president republican senate vote",
    "Science": "analysis biology chemistry clinical discovery disease evidence experiment health hypothesis innovation laboratory medical medicine methodology pharmaceutical physics research science scientific study theory treatment",
    "Sports": "athlete baseball basketball championship coach competition exercise fitness football game golf hockey league match olympics player racing running score soccer sports swimming team tennis tournament training",
    "Technology": "algorithm analytics artificial automation blockchain cloud code computer computing cryptocurrency cybersecurity data development digital hardware innovation intelligence internet learning machine programming robotics software technology",
    "Travel": "accommodation adventure airport booking city country culture destination experience explore flight guide hotel itinerary journey passport restaurant sightseeing tourism tourist travel trip vacation visa visit",
}.items()}

SEARCH_STOP = """
a about after again all an and are as at be been before but by can could down for from further had has have he her him how if in is it its just may
more of on once out over should than that the their then there these they this those through to under up was what when where which who why will with
would
""".split()

PHRASE_STOP = """
a able above afraid after again against age ago agree air allow almost along also always am among an and anger animal another any appear apple are
area arm around arrange arrive art as asked at atom away baby back bad ball band bank bar base basic bat be bear beat beauty because bed before began
begin behind being believe bell below best better between big bird bit black block blood blue board boat body bone book born both bought box boy
branch bread bright bring broad broke brother brought brown burn busy but buy by came camp capital captain car card care carry case cat catch caught
cell cent center century certain chair chance character charge chart check chick chief child children choose chord circle claim class clear climb
clock clothe cloud coast coat cold collect colony color column come common company compare complete condition connect consider consonant contain
continent continue control cook copy corn corner correct cost cotton count country course cow create crop crowd cry current cut dad dance danger dark
day dead deal dear death decide decimal deep degree depend describe desert determine develop dictionary different difficult direct discuss distant
divide division do doctor does dog dollar don done door double dream dress drink drive drop dry duck during each ear early earth ease east eat edge
effect egg eight either electric element else end enemy energy engine enough enter equal equate especially even evening event ever every example
excite exercise expect experience face fact fair fall family famous far fast fat father favor fear feed feel feet fell felt few field fig fight figure
fill final fine finger finish fire fish fit five floor flow flower fly food foot for force forest form forward found four fraction free fresh friend
from front fruit full fun game garden gas gather gave general gentle get girl give glad glass go going gold gone good got govern grand grass gray
great green grew ground group guess guide gun had hair half hand happen happy has hat have he head hear heard heart heat heavy held help her here high
hill him history hit hold home hope horse hot hour house how huge human hundred hunt hurry ice idea if imagine important in inch include indicate
industry insect instant instrument interest into invent is island it its job joy jump just keep kept kill kind king knew lake land language large last
laugh law lay lead leave led left leg length less let letter level lie life lift light like line liquid list listen live locate log lone look lost
loud love machine magnet main major make man many map mark market mass master match material matter me meant measure meat meet men metal method middle
might mile milk million mind mine minute miss mix modern molecule moment money month moon more morning most mother motion mount mountain much multiply
music must name nation natural nature necessary neck need neighbor never new next night nine noise noon nor north nose note nothing notice noun number
numeral object observe occur ocean of off offer often oh oil old on once open operate opposite order organ original our out own oxygen page paint pair
paper paragraph parent part particular party pass past path pattern pay perhaps period person phrase pick picture piece pitch place plain plan plane
planet please plural poem populate pose position possible post pound power practice prepare present pretty print probable problem process produce
product proper property protect prove provide pull push put quart question quick quiet quite quotient race radio rail rain raise ran range rather
reach read ready reason record red region remember repeat reply represent require rest result rich ride right ring river road rock roll room root rope
rose rub rule safe said sail salt same sand sat save saw say scale school science score search season seat second section seem segment select sell
send sense sent separate serve set settle seven several shall shape share sharp she sheet shell shine ship shoe shop shore short should shoulder show
side sight sign silent silver similar simple since sing sister sit six size skill sky slave sleep slip slow small smell snow so soft soil soldier
solution solve some something son song soon sound south space speak special speech speed spend spoke spot spread spring square star station stay stead
steam steel step still stone stood store straight strange stream street stretch string strong student study subject substance subtract success such
sudden suffix sugar suit summer supply support sure surface surprise swim syllable system table tail take talk tall teach team teeth tell temperature
ten term test thank that the their them then these they thick thin think third this those though thought thousands three through throw thus tie time
tiny tire to together told too took tool top total touch toward town track train travel triangle truck tube two type under unit until up us usual
valley value vary verb very view village visit voice vowel wait walk wall want war warm was wash watch wave wear weather week weight well went west
what wheel where whether which while white whole whose why wide wife wild will win wind window wing winter wire wish with without woman women won
wonder wood words work world would write written wrong year yellow yes yet young
""".split()

# code: name, common words (repeats count), letters of its character class, ranges of its script
LANGUAGES: dict[str, tuple[str, list[str], str, str]] = {
    "en": ("English", "a all an and as at be but by do for from have he her his i in it my not of on one or say she that the their there they this to we will with would you".split(), "a-zA-Z", "A-Za-z"),
    "es": ("Spanish", "a al con da de del el en era está fue han la le lo muy no para por que se ser son su te todo un una y".split(), "a-zA-ZñáéíóúüÑÁÉÍÓÚÜ", "A-Za-zÀ-ÿ"),
    "fr": ("French", "avec avoir ce dans de en et et grand il le même ne par pas plus pour quand que se son sur tout un une à être".split(), "a-zA-ZàâäéèêëïîôöùûüÿçÀÂÄÉÈÊËÏÎÔÖÙÛÜŸÇ", "A-Za-zÀ-ÿ"),
    "de": ("German", "als an auch auf aus das dass dem den der des die ein eine er es für hat im in ist mit nicht sich und von werden zu".split(), "a-zA-ZäöüßÄÖÜ", "A-Za-zÀ-ÿ"),
    "pt": ("Portuguese", "a ao as com como da das de do dos e ele em foi mais mas na no não o os para por que se tem um uma à é".split(), "a-zA-ZãáàâéêíóôõúçÃÁÀÂÉÊÍÓÔÕÚÇ", "A-Za-zÀ-ÿ"),
    "it": ("Italian", "a abbiamo che ci con da di e fra gli ha hai ho i il in la le lo non per si sono su tra un una uno è".split(), "a-zA-ZàèéìíîòóùúÀÈÉÌÍÎÒÓÙÚ", "A-Za-zÀ-ÿ"),
    "ru": ("Russian", "а быть в весь вы для же за и из к как мой мы на не он она они оно от по с так тот у что это этот я".split(), "а-яё", "А-яё-ё"),
    "zh": ("Chinese", "一 上 不 个 中 为 了 于 人 他 以 们 作 出 到 和 国 在 地 大 我 时 是 有 来 生 用 的 要 这".split(), "一-鿿", "一-鿿"),
    "ja": ("Japanese", "ある いる から が こと さ し する た て で と として な に の は も れ を".split(), "぀-ゟ゠-ヿ一-鿿", "぀-ゟ゠-ヿ一-鿿"),
    "ar": ("Arabic", "أن أو إلى التي الذي بعد بين على عند غير في قد كان كل لا ما من هذا هذه".split(), "؀-ۿ", "؀-ۿ"),
}

SEARCH_SYNONYMS: dict[str, list[str]] = {k: v.split(', ') for k, v in {
    "bad": "awful, poor, terrible",
    "big": "huge, large, massive",
    "create": "build, construct, make",
    "delete": "drop, erase, remove",
    "fast": "quick, rapid, speedy",
    "good": "excellent, fine, great",
    "new": "fresh, latest, recent",
    "old": "aged, ancient, vintage",
    "search": "find, lookup, query",
    "small": "little, minor, tiny",
    "update": "change, edit, modify",
}.items()}

QUERY_SYNONYMS: dict[str, list[str]] = {k: v.split(', ') for k, v in {
    "best": "finest, greatest, optimal, top",
    "create": "build, construct, generate, make",
    "delete": "destroy, eliminate, erase, remove",
    "error": "bug, fault, issue, mistake",
    "fast": "quick, rapid, speedy, swift",
    "find": "discover, locate, retrieve, search",
    "get": "acquire, fetch, obtain, retrieve",
    "help": "aid, assist, guide, support",
    "new": "fresh, latest, novel, recent",
    "problem": "challenge, difficulty, issue, trouble",
    "show": "display, exhibit, present, reveal",
    "update": "change, edit, modify, revise",
}.items()}

QUERY_CONCEPTS: dict[str, list[str]] = {k: v.split(', ') for k, v in {
    "database": "data management, data storage, information retrieval, persistence",
    "machine learning": "AI models, artificial intelligence, deep learning, neural networks",
    "search": "discovery, finding, query, retrieval",
    "vector": "embedding, feature vector, numerical encoding, representation",
}.items()}

QUERY_DOMAINS: dict[str, list[str]] = {k: v.split(', ') for k, v in {
    "business": "company, customer, market, marketing, profit, revenue, sales",
    "health": "disease, doctor, health, medical, medicine, patient, treatment",
    "science": "experiment, hypothesis, research, scientific, study, theory",
    "tech": "ai, api, artificial, code, computer, database, embedding, intelligence, java, learning, machine, programming, python, software, technology, tensorflow, vector",
}.items()}
