"""What a block of text says about itself: an unfilled variable, filler, or a message instead of content.

Placeholders are told by the syntax of template variables. Filler and messages are told by what their words are, not by whole
phrases: every word of a sentence has a part (a thing pages consist of, an act asked of an author, a state of failure, a small
word of the grammar), and a sentence is evidence if it has the part that carries it and nearly all of its other words belong
to the same talk. A longer sentence about a failure has words of its own subject and therefore is none.

Most blocks hold none of the strings without which there is no evidence; one automaton over all of them settles that.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache

import ahocorasick

PLACEHOLDER_BIT, FILLER_BIT, MESSAGE_BIT = 1, 2, 4

# Placeholders.

_NAME = r"[A-Za-z_][\w.\-:]*"
_SLOT = r"(?:insert|your|name|title|date|address|company|city|e-?mail|phone|number|headline|heading|description|url|link|logo|image|photo|text|price|product|site|author|month|year|tbd|tba|tbc|todo|placeholder|here)"
PLACEHOLDER = re.compile(
    rf"\{{\{{[^{{}}\n]+\}}\}}|\$\{{[^{{}}\n]+\}}|#\{{[^{{}}\n]+\}}|\{{\$\s*{_NAME}\}}|(?<![\w/\\.=(}}])(?<!= )\{{\s*[A-Za-z_][\w.\-:]+\s*\}}(?![\w/(])|\{{[%#!*+]-?[^{{}}\n]*?[%#!*+]?\}}"
    rf"|\[\[[+*~%]?\s*{_NAME}\s*\]\]|\[%-?[^\[\]%]+%\]|%%\s*{_NAME}\s*%%|(?<![\w%])%[A-Z][A-Z0-9_.]+%(?![\w%])|(?<!\w)%\(\w+\)[sd]|@@\s*{_NAME}\s*@@|##\s*{_NAME}\s*##|(?<![\w$])\$[A-Z][A-Z_]+\$"
    rf"|\*\|\s*{_NAME}\s*\|\*|[<‹«]%[-=]?[^<>‹›%]*%[>›»]|[<‹]\?(?:php|=)[^<>‹›]*\?[>›]|[<‹](?:your|insert|enter|my) [\w. ]+[>›]|(?<!\w)__[A-Za-z][\w.]*?__(?!\w)"
    rf"|\((?:your )?{_NAME}(?: \w+)? goes here\)|\[{_NAME}(?: \w+)? (?:tbd|tba|tbc|here)\]|\[(?:[\w.'-]+ )*?{_SLOT}(?: [\w.'-]+)*\]|\[object Object\]",
    re.I,
)
#: Two of the forms depend on capitals, which the pattern as a whole does not.
_CAPITALS = re.compile(r"^(?:%[A-Z][A-Z0-9_.]+%|\$[A-Z][A-Z_]+\$)$")
#: Words by which a sentence shows that it talks about a template instead of being one.
EXPLAINS = re.compile(
    r"\b(?:example|shows? how|explain\w*|filled in|fills? in|templates?|template engine|placeholders?|variables?|syntax|the tool|letter|write|type|puts? in|replac\w+|stands? for|documentation|guide|tutorial|manual|called|named|such as|expression|notation|means)\b",
    re.I,
)
_QUOTES = re.compile(r"[“”„«»]|(?<!\w)\"[^\"]+\"")
_SENTENCE = re.compile(r"(?<=[.!?…。])\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[^\s\w]*[/\\][^\s]*")


def is_placeholder(block: str) -> bool:
    """Whether a block holds an unfilled variable in a sentence that does not explain it."""
    if not PLACEHOLDER.search(block):
        return False
    for s in _SENTENCE.split(block):
        for m in PLACEHOLDER.finditer(s):
            hit = m.group()
            if hit[0] in "%$" and hit[1] not in "%{(" and not _CAPITALS.match(hit):
                continue
            rest = PLACEHOLDER.sub(" ", s)
            if not (_QUOTES.search(rest) or EXPLAINS.search(rest)):
                return True
            break
    # A variable may hold the end of a sentence.
    return False


# Filler.

_LATIN_STEM = r"(?:adi|ali|am|cona|con|dolo?r?|elit|enim|exer|inc|lab|mag|min|nost|or|pis|qua|sect|sed|sit|temp|ut|ven)"
_LATIN_END = r"(?:us|um|am|is|it|et|or|ore|a|e|ium|ius|adi|ora|re)?"
LATIN = re.compile(rf"(?:{_LATIN_STEM}+{_LATIN_END}|lorem|loremus|ipsum|ipsa|situs|incididunt|consectetur|adipiscing|eiusmod|aliqua|veniam|quis|nostrud|exercitation|ullamco|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|do|et|ac|vitae|nec|vel)", re.I)
#: The small words of a few languages, which belong to any talk.
_GRAMMAR = frozenset(
    """a an the this that these those it its it's you your yours you're we we're we've we'll our ours us i i'm my me they their he she one any all some no of for to in on at by with from as into out up off about over under behind through
    is are was were be been being am isn't aren't wasn't has have had having hasn't haven't hadn't do does did doing don't doesn't didn't can can't cannot could couldn't may might must shall should will would won't wouldn't
    and or but if so because while when where until before after than then not nor just only also again now here there please kindly first second soon later back more most less very too yet still once
    der die das den dem des ein eine einen einem einer dieser diese dieses diesem ihr ihre ihren ihrem ihrer sie wir ist sind war wurde wird werden hat haben nicht nie nur und oder aber zu zur zum im in auf mit von für es sich bitte leider mehr noch um
    el la los las un una este esta esta este su sus ha han hemos he es está están no y o pero que de del en para por con se lo le más ya
    le les des du cette ce cet votre vos nous vous est sont a été n'est n'a ne pas plus et ou mais que qui dans sur pour par avec il elle
    il lo gli questo questa è sono non e di da per con het de een deze dit niet zijn""".split()
)
#: Things that a page is made of and that an author is asked to fill in.
_PARTS = frozenset(
    """address advert banner bio biography blog body brand button caption category city company contact content copy cover date description detail details document email entry event excerpt figure footer form gallery head header heading headline
    hours image info information intro introduction item label link list logo map menu message motto name news note number opening page paragraph people phone photo picture piece post price product profile project quote section sentence service sidebar
    site slogan slot space story subtitle summary tagline team telephone testimonial text title topic video visitors website welcome widget word words yourself line lines story self short long new own two three four settings editor block
    überschrift titel text absatz inhalt bild beschreibung untertitel seite texto título contenido descripción imagen párrafo página texte titre contenu description image paragraphe testo titolo contenuto tekst""".split()
)
#: Acts asked of an author.
_ACTS = frozenset("add change choose click customize customise describe double-click edit enter fill give input insert introduce paste place provide put replace select share supply tap tell type update upload use write begins starts start go goes comes come appears appear belongs".split())
#: Words by which filler calls itself so, and what announces content that is not there.
_FILLERS = frozenset(
    """another dummy sample placeholder filler example demo test testing temporary default blank blind blindtext lorem ipsum tbd tba tbc todo coming follow follows ignore replaced announced confirmed added supplied untitled
    platzhalter blindtext beispieltext mustertext fülltext probetext folgt ersetzt ejemplo relleno prueba muestra rellenar provisional provisoire factice remplissage exemple segnaposto esempio prova voorbeeldtekst something anything nothing wird
    hello world""".split()
)
_HERE = re.compile(r"\b(?:here|below|in this space|with your own|your own|in the (?:settings|editor)|hier|aquí|ici|qui)\b")
_AUTHOR = re.compile(r"^(?:click|double-click|tap)? ?(?:here )?(?:to )?(?:please )?(?:add|change|customi[sz]e|describe|edit|enter|fill(?: in)?|insert|introduce|paste|place|provide|put|replace|supply|tell|type|update|upload|write)\b")
_SELF = re.compile(
    r"^(?:this|here|these|it)(?: page| post| text| site| article| title| heading| image| paragraph| block| section)*(?: is| are|'s) (?:\w+ ){0,4}(?:example|sample|dummy|placeholder|filler|test|default|demo|temporary)\b|^(?:some |an? )?(?:dummy|sample|placeholder|filler|example|test|default|demo|blind|temporary)(?: \w+)?[ -](?:copy|text|content|page|post|title|heading|description|paragraph|entry|caption|image|headline|article)\b"
    r"|^just another\b.*\b(?:site|blog|tagline|page|website|weblog)\b|\bto follow$|^(?:\w+ ){0,4}coming soon$|\bto be (?:added|announced|confirmed|replaced|written|supplied|filled in|defined|determined)\b|\b(?:goes|go|comes|will go|will appear|appears?|belongs) here\b|^(?:tbd|tba|tbc|todo|untitled|blindtext|platzhalter|mustertext|beispieltext)\b"
    r"|\b(?:texto|título|contenido) de (?:ejemplo|relleno|prueba|muestra)\b|\btexte (?:provisoire|factice|d'exemple|de remplissage)\b|\btesto (?:segnaposto|di (?:prova|esempio))\b|\b(?:text|inhalt|beschreibung|titel) (?:folgt|kommt hier)\b|^hello world$|\blorem ipsum\b|^this is where .* (?:begins|starts|goes)$|^replace me$|^placeholder$|^hier (?:steht|kommt|erscheint)\b|^your [\w ]*(?:here|in one short line)$|^(?:ihr|dein) \w+ (?:kommt )?hier|^(?:votre|tu|su) \w+ (?:ici|aquí)"
)
_BARE_ORDER = re.compile(r"^(?:add|edit|enter|insert|type|write|change|your|ihre?|dein|votre|tu|su) (?:\w+ )?(?:text|title|subtitle|heading|headline|caption|description|paragraph|content|copy|slogan|tagline|label|überschrift|titel|beschreibung|titre|título)(?: here| hier| ici| aquí)?$|^(?:contenu|contenido|inhalt|text|texte|texto) (?:à venir|por venir|folgt|en camino)$|^hier kommt\b")
_ROW = re.compile(r"(?:asdf|sdf|qwer|wert|jkl|hjkl|fghj|yxcv|zxcv|qwertz?u?i?o?p?|asdfghjkl|abc|xyz|foo|bar|baz|bla|blah|xxx+|aaa+|yyy+|test|text|word|lorem|ipsum)+[.,;:!?]*", re.I)


def is_latin(block: str) -> bool:
    """Whether a block is the pseudo-Latin of typesetters."""
    words = re.findall(r"[^\W\d_]+", block)
    if len(words) < 5 or not any(LATIN.fullmatch(w) for w in words[:3]):
        return False
    return sum(1 for w in words if LATIN.fullmatch(w)) >= 0.75 * len(words)


def _filler_sentence(s: str) -> bool:
    """Whether a sentence in lower case asks for content or calls itself a stand-in, and says nothing else."""
    words = [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", s)]
    if not words or len(words) > 24:
        return False
    own = [w for w in words if w not in _GRAMMAR]
    known = [w for w in own if w in _PARTS or w in _ACTS or w in _FILLERS]
    if len(words) <= 4 and _BARE_ORDER.search(s):
        return True
    if _SELF.search(s):
        # Words of its own: the thing that is to come, or what it stands for.
        return len(own) - len(known) <= max(1, len(own) // 3)
    if _AUTHOR.search(s) and (_HERE.search(s) or "your" in words or "this" in words) and any(w in _PARTS for w in own):
        return len(own) - len(known) <= max(1, len(own) // 4) and (bool(_HERE.search(s)) or "yourself" in words or len(own) == len(known))
    return False


_CAPITAL = re.compile(r"(?<=[.!?])\s+|(?<=[\w.])\s+(?=[A-ZÄÖÜÉ][a-zäöüßé]+\b)")


def _bare(s: str) -> str:
    return s.strip(" .,;:!?…()[]*-–—").replace("’", "'")


def is_filler(block: str) -> bool:
    """Whether nothing of a block is left without stand-in sentences, repeated words and pseudo-Latin."""
    # Every sentence must be filler, so the first one, or its part up to a capital, mostly settles it.
    first = _SENTENCE.split(block, maxsplit=1)[0]
    begin = [w.strip(".,;:!?…") for w in first.lower().split()]
    if len(begin) >= 4 and not any(a == b for a, b in zip(begin, begin[1:])) and len(set(begin)) > 2:
        part = _CAPITAL.split(first, maxsplit=1)[0]
        if not (_filler_sentence(_bare(first.lower())) or (part != first and _filler_sentence(_bare(part.lower())))):
            return is_latin(block)
    words = block.split()
    bare = [w.lower().strip(".,;:!?…") for w in words]
    if not bare:
        return False
    if len(bare) >= 6 and len(set(bare)) <= len(bare) // 3 <= 4 and any(b.isalpha() for b in bare):
        return True
    # Words that repeat their neighbour go first, or a sentence could hold one of them.
    single = [w for i, w in enumerate(words) if bare[i] not in (bare[i - 1] if i else None, bare[i + 1] if i + 1 < len(bare) else None)]
    if len(words) - len(single) in (1, 2) and len(single) < 2:
        return False
    gone = len(words) - len(single)
    rest = " ".join(w for w in single if not (gone >= 3 and _ROW.fullmatch(w)))
    if not re.search(r"\w", rest):
        return gone >= 3
    low = rest.lower()
    if all(_filler_sentence(_bare(s)) for s in _SENTENCE.split(low) if re.search(r"\w", s)):
        return True
    # Sentences without a stop between them: taken apart where the next one begins with a capital.
    parts = _CAPITAL.split(rest)
    if len(parts) > 1 and all(_filler_sentence(_bare(s.lower())) for s in parts if re.search(r"\w", s)):
        return True
    return is_latin(rest)


# Messages.

#: Things that fail.
_THINGS = frozenset(
    """page pages document file files article product address resource item url uri content link entry site website webpage web server servers service services shop store portal account request requests connection database gateway host hostname domain session application app map directory
    folder access browser upstream proxy network system location path object record data cookies cookie captcha area feature user username visitor website's webmaster administrator admin owner support team number code reference id ray ip bookmark index listing log page's homepage home resources content's permission permissions
    http https www error errors fault status seite datei dokument server artikel adresse website zugriff verbindung dienst shop fehler página documento archivo servidor sitio acceso recurso error fichier serveur accès ressource erreur connexion pagina sito errore navigateur navegador internetseite webseite dirección adresse""".split()
)
#: States of failure and what is said beside them.
_STATES = frozenset(
    """found find unavailable available missing gone exist exists existing removed deleted moved expired denied forbidden refused blocked banned suspended disabled deactivated closed down offline restricted unauthorized unauthorised allowed authorized authorised permitted permission failed failure fail broken
    timed timeout time out bad internal gateway unexpected invalid occurred happened encountered problem problems issue issues exception overloaded overload busy maintenance repairs repair construction upgrading updated updating update scheduled temporarily momentarily currently temporary short while moment moments minute minutes few hour hours
    sorry oops whoops uh-oh uhoh ooops apologies apologize apologise inconvenience regret unfortunately wrong went something looks like reached reach loaded load loads loading displayed display opened open opens processed process completed complete retrieved retrieve located understood served serve respond responding response answer answered sent gave met
    condition unable try trying retry reload refresh return returned come check checking spelling correct incorrectly typed mistyped wait patience thank thanks contact working fixing fix many requests limit exceeded passed rate reset refused requested looking looked asked request method supported unsupported longer anymore changed change renamed name lives nothing such
    establishing establish attention required require requires needed need verify verifying verification human robot robots security step connection secure continue proceed go see view use order loading disabled enabled enable activate activated allow switch turn permit run runs running works work supported support properly correctly function functions functionality full experience use
    javascript js script scripts scripting cookies engineers team notified aware resolved shortly being let know following detail details information visit homepage start previous main click mistake listed off on side end our shop's permanently moved list null hosting provider slow log sign again yet visible accessible unreachable unsupported incompatible outdated refreshing reloading overwhelmed capacity traffic limits hosting's online right turned dns resolution resolve ssl certificate handshake robot's crawler's firewall protected protection rules policy violation client client-side side lookup registered parked sale given unknown variable cannot memory missing call because perhaps either possibly maybe perform instead""".split()
)
#: The same in German, Spanish, French and Italian.
_FOREIGN = frozenset(
    """gefunden existiert gibt verfügbar erreichbar verweigert gesperrt wartung wartungsarbeiten gewartet vorübergehend momentan derzeit bald später erneut versuchen versuchen sie zurück browser ausgeschaltet deaktiviert aktivieren aktiviert einschalten eingeschaltet benötigt erforderlich entschuldigung fehlgeschlagen aufgetreten führen gerade durch geschlossen überlastet erreichen anfrage inhalte
    encontrado encontrada encontramos existe disponible denegado prohibido mantenimiento temporalmente vuelva vuelve tarde inténtelo inténtalo nuevo activa active activar habilite habilita desactivado necesita requiere continuar lo sentimos error interno solicitada ocurrido algo salió mal cerrado busca solicitado
    introuvable trouvée trouvé existe indisponible refusé interdit maintenance momentanément réessayez tard activer activez activé veuillez désactivé requis nécessaire désolé oups erreur interne demandée demandé trouver recherchez surchargé scripts continuer produite
    trovata trovato disponibile negato vietato manutenzione temporaneamente riprova tardi attiva abilita richiesto""".split()
)
_SERVERS = frozenset("nginx apache iis cloudflare varnish openresty litespeed tomcat jetty fastly akamai haproxy squid".split())
#: Words of a sentence that is about messages and therefore none.
_EXPLAINED = frozenset("how why whether explain explains explained lesson lessons learn tutorial guide tips compare means meaning called handler counter column story review".split())
_TALK = _THINGS | _STATES | _FOREIGN | _SERVERS
_DO = r"(?:enable|activate|allow|switch on|turn on|permit|aktivier\w*|einschalten|activa|activar|active|habilit\w+|activez|activer|attiva|abilita)"
_JS = r"(?:js|java ?scripts?|scripts?|scripting)"
#: What makes a sentence a message, if the rest of it belongs to the same talk.
TRIGGER = re.compile(
    r"\b(?:not|never|cannot|can't|couldn't|isn't|wasn't|aren't|doesn't|don't|unable to|no longer|failed to|won't)(?: be)?(?: currently| longer| been| yet| seem to| appear to| to)? (?:found|find|available|exist|exists|reach|reached|load|loaded|display|displayed|open|opened|located?|respond|responding|process|processed|complete|completed|connect|allowed|authori[sz]ed|permitted|accessible|supported?|retrieved?|working|work|run|have (?:permission|access)|here|function|be found)\b"
    r"|\b(?:is|are|was|has|have|has been|have been|been|be|currently|temporarily) (?:\w+ )?(?:gone|missing|unavailable|expired|suspended|disabled|deactivated|removed|deleted|down|offline|overloaded|denied|blocked|refused|forbidden|restricted|banned|timed out|closed(?: for)?|undergoing maintenance|inactive|not public|being updated|under maintenance|undergoing|broken|been (?:removed|deleted|moved|suspended|disabled|blocked))\b"
    r"|\b(?:page|file|document|url|article|resource|item|content|site|link|address) (?:not found|missing|unavailable|expired|removed|deleted|gone|moved)\b|\bnot found\b|\bno such (?:file|page|document|host)\b|\b(?:internal )?server (?:error|fault)\b|\bbad (?:gateway|request)\b|\bgateway time-?(?:out)?\b|\bservice (?:temporarily )?unavailable\b|\bunavailable$|^(?:temporarily )?unavailable\b|^forbidden$|^unauthori[sz]ed$"
    r"|\b(?:connection|database|network|application|system|runtime|script|server) error\b|\btimed out\b|\bnothing (?:here|found|to see|to show)\b|\b(?:has|with) no index\b|\blisting (?:is )?(?:off|denied|disabled|not allowed)\b|\b(?:access|permission|request|connection) (?:to .{1,40} )?(?:is |was |has been )?(?:denied|refused|blocked|forbidden|rejected|reset|timed out|failed)\b|\btoo many requests\b|\brate limit\b|\b(?:limit|quota) (?:has been )?exceeded\b|\b(?:time|request|connection) ?(?:limit passed|limit reached|timed out|timeout)\b|\b(?:something|that) (?:has gone|went) wrong\b|\ban? (?:\w+ )?error (?:has )?(?:occurred|happened)\b|\berror (?:establishing|loading|connecting|processing|while|occurred)\b"
    r"|\b(?:could not|cannot|can't|couldn't|unable to|failed to) (?:reach|find|connect|load|open|establish|locate|display|process|complete)\b|\bunexpected (?:condition|error)\b|\b(?:under|for|scheduled|in|undergoing) (?:\w+ )?(?:maintenance|repairs?|construction)\b|\bmaintenance (?:mode|break|work|page|in progress)\b|\b(?:we'll|we will|will) be (?:right )?back\b|\b(?:be|right|back) (?:back )?(?:soon|shortly|online)\b"
    r"|\b(?:http|https|error|status|code|fault|fehler|erreur)(?:[ :#-]+(?:error|code|status))*[ :#-]*[45]\d\d\b|^[45]\d\d(?:\s*[-–—|:.]?\s*\S.*)?$"
    rf"|\b{_DO} (?:\w+ ){{0,3}}{_JS}\b|\b(?:turn|switch) (?:\w+ )?{_JS} on\b|\b{_JS} (?:\w+ )?(?:must|needs?|has|have|is|are|seems|appears|support)(?: to)?(?: be)? (?:\w+ )?(?:allowed|enabled|activated|switched|turned|required|disabled|off|needed|run|inactive)\b|\b{_JS}[ -](?:is |are )?(?:disabled|required|needed|off)\b|\b(?:works? only|only works?|requires?|needs?|without|(?:does not|doesn't) (?:support|run)|unable to run|rel(?:y|ies) on|depends? on)(?: with| \w+)? {_JS}\b|\bjavascript (?:ist|est|está|è) .*(?:ausgeschaltet|deaktiviert|désactivé|desactivado|erforderlich|requis)|\b(?:bitte|veuillez|por favor)\b.*\b{_JS}\b"
    r"|\bchecking your browser\b|\bverify(?:ing)? (?:that )?you(?:'re| are) (?:a )?human\b|\battention required\b|\b(?:are you|not) a robot\b|\bjust a moment\b|\bcaptcha\b|\b(?:dns|ssl|name) (?:\w+ )?(?:error|failed|failure)\b|\b(?:javascript|js|scripts?|scripting|cookies) (?:\w+ ){0,2}(?:turned|switched) off\b|\bone more step\b|\bunusual traffic\b|\bddos protection\b|\bsecurity check\b"
    r"|\bnicht (?:mehr )?(?:gefunden|verfügbar|erreichbar|vorhanden)\b|\bgibt es (?:\w+ )?nicht\b|\bexistiert (?:leider )?nicht\b|\bzugriff (?:\w+ )?(?:verweigert|gesperrt)\b|\bwartung(?:sarbeiten)?\b|\bgewartet\b|\bein (?:\w+ )?fehler ist\b|\bintrouvable\b|\bnon trouvée?\b|\bn'existe (?:pas|plus)\b|\bindisponible\b|\baccès (?:refusé|interdit)\b|\b(?:en|de) (?:maintenance|mantenimiento|manutenzione)\b|\bno (?:hemos |se (?:ha )?|fue |ha sido )?encontr\w+\b|\bno existe\b|\bno (?:está )?disponible\b|\bacceso (?:denegado|prohibido)\b|\bnon (?:è stata )?trovata\b|\baccesso negato\b|\berreur interne\b|\berror interno\b"
)
_TRACE = re.compile(
    r"traceback \(most recent call last\).*|(?:php )?(?:fatal error|parse error|syntax error|warning|notice|uncaught (?:\w+ )?(?:exception|error|\w*error)|deprecated)\s*: .*(?:on line \d+|in [/\\<]\S*.*|at \S+:\d+.*)|.*\b(?:exception|error)\b.*\bat [\w.$<>]+\([\w.]*:?\d*\).*|server error in '.*' application.*|(?:java|javax|system|org)\.[\w.]+(?:exception|error)\b.*|sqlstate\[\w+\].*|ora-\d{5}.*|(?:undefined|unknown) (?:variable|index|offset|property|method|constant)\b.*"
    r"|(?:mysql|postgres\w*|database|sql) (?:error|server has gone away)\b.*|segmentation fault.*|stack trace:.*|uncaught \w*error\b.*",
    re.S,
)
_TRACE_HINT = re.compile(r"traceback|warning|notice|error|exception|deprecated|sqlstate|ora-|undefined|unknown|mysql|fault|trace")
#: A title cut off in the middle of a trace.
_TRACE_START = re.compile(r"(?:php )?(?:fatal error|parse error|warning|notice)\s*: .*\(\) in /\S*.*", re.S)


@cache
def _starts() -> frozenset[str]:
    """Beginnings of the words of the talk: a title may be cut off within a word."""
    return frozenset(w[:n] for w in _TALK for n in range(3, len(w)))


def _share(s: str, cut: bool) -> float:
    """The share of the words of a sentence, small ones aside, that belong to the talk of failing pages."""
    words = _WORD.findall(s)
    if not _EXPLAINED.isdisjoint(words):
        return 0.0
    own = [w for w in words if w not in _GRAMMAR]
    if not own:
        return 1.0 if words else 0.0
    known = sum(1 for w in own if w in _TALK or w.isdigit())
    if cut and own and own[-1] not in _TALK and own[-1] in _starts():
        known += 1
    return known / len(own)


def _message_sentence(s: str, cut: bool) -> tuple[bool, bool]:
    """Whether a sentence is a message by itself; whether it can stand beside one."""
    if _TRACE_HINT.search(s) and (_TRACE.fullmatch(s) or (cut and _TRACE_START.fullmatch(s))):
        return True, True
    share = _share(s, cut)
    return bool(share >= 0.7 and TRIGGER.search(s)), share >= 0.7


def is_message(block: str) -> bool:
    """Whether a block is an error, outage, refusal or scripts-required message and says nothing else."""
    low = block.lower().replace("’", "'").strip(" .!…-–—|:")
    if not low:
        return False
    cut = 50 <= len(block) <= 80 and block[-1:].isalpha()
    if _TRACE_HINT.search(low) and (_TRACE.fullmatch(low) or (cut and _TRACE_START.fullmatch(low))):
        return True
    if _QUOTES.search(block):
        return False
    sentences = [x for x in (s.strip(" .!?…-–—|:") for s in _SENTENCE.split(low)) if x]
    found = False
    for i, s in enumerate(sentences):
        own, beside = _message_sentence(s, cut and i == len(sentences) - 1)
        if not beside:
            return False
        found = found or own
    return found


_TITLE_PARTS = re.compile(r"\s+[|–—·•»-]\s+|:\s+")


def is_title_message(title: str) -> bool:
    """Whether a title is a message, or names one before or behind the name of the site."""
    if is_message(title):
        return True
    parts = _TITLE_PARTS.split(title)
    return 1 < len(parts) <= 4 and any(len(p.split()) >= 2 and is_message(p) for p in (parts[0], parts[-1]))


# One look for all three.

_HINTS = {
    PLACEHOLDER_BIT: "{{ ${ #{ {% {$ {! {* {+ [[ [% %% %( @@ ## *| <% ‹% «% <? ‹? <your <insert <enter <my ‹your ‹insert ‹enter ‹my __ goes\xa0here tbd] tba] tbc] here] [insert [your [object".split(),
    FILLER_BIT: "here|to follow|folgt|lorem|ipsum|your|enter |type |write |change |ihr|dein|votre|venir|replace|ersetzt|change this|edit|story begins|tagline|just another|in this space|dummy|sample|placeholder|filler|example|blindtext|platzhalter|mustertext|beispieltext|texto de|texte |testo |to be |coming soon|tbd|tba|todo|untitled|test|default|demo|temporary|hello world|aquí|hier|yourself|add |insert|describe".split("|"),
    MESSAGE_BIT: (
        "not found|n't |not |cannot|unable|longer|failed|gone|missing|unavailable|expired|suspended|disabled|removed|deleted|down|listing|nothing|offline|overloaded|denied|blocked|refused|forbidden|restricted|timed|closed|updated|maintenance|repair|construction|broken|no such|server error|server fault|bad gateway|bad request|gateway|unauthori|rejected|too many|rate limit|"
        "exceeded|limit|wrong|error|unexpected|be back|back soon|soon|shortly|http|status|code|fault|fehler|erreur|40|41|42|50|javascript|java script|script|js|checking your|human|captcha|verweigert|zugriff|banned|dns|turned off|attention|robot|just a moment|one more step|traffic|ddos|security check|nicht|wartung|gewartet|introuvable|non trouv|n'existe|indisponible|accès|mantenimiento|manutenzione|encontr|"
        "no existe|disponible|acceso|trovata|accesso|traceback|warning|notice|exception|deprecated|sqlstate|ora-|undefined|unknown|mysql|segmentation|moved"
    ).split("|"),
}
_BRACE = re.compile(r"\{\s*[A-Za-z_][\w.\-:]*\s*\}|%[A-Z][A-Z0-9_.]+%|\$[A-Z][A-Z_]+\$|\[[^\[\]]*\]|\(\S+(?: \S+){2,4}\)")


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, int] = {}
    for bit, words in _HINTS.items():
        for w in words:
            w = w.replace("\xa0", " ")
            kinds[w] = kinds.get(w, 0) | bit
    for w, k in kinds.items():
        a.add_word(w, k)
    a.make_automaton()
    return a


def hints(block: str) -> int:
    """Which kinds of evidence a block may hold; others it does not."""
    out = 0
    for _, k in _automaton().iter(block.lower()):
        out |= k
        if out == 7:
            return out
    if not out & PLACEHOLDER_BIT and ("{" in block or "%" in block or "$" in block or "[" in block or "(" in block) and _BRACE.search(block):
        out |= PLACEHOLDER_BIT
    return out


@lru_cache(maxsize=20_000)
def of_block(block: str, title: bool = False) -> int:
    """The kinds of evidence in a block, as bits."""
    may = hints(block)
    out = 0
    if may & PLACEHOLDER_BIT and is_placeholder(block):
        out |= PLACEHOLDER_BIT
    words = block.split(None, 40)
    # Filler without any of the strings repeats its words or is pseudo-Latin.
    if (may & FILLER_BIT or (len(words) >= 3 and (len({w.lower() for w in words}) * 1.5 <= len(words) or LATIN.fullmatch(words[0].strip(".,;:")) or LATIN.fullmatch(words[1].strip(".,;:"))))) and is_filler(block):
        out |= FILLER_BIT
    if may & MESSAGE_BIT and (is_title_message(block) if title else is_message(block)):
        out |= MESSAGE_BIT
    return out
