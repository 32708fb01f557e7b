"""Template residue, filler, error pages and script notices in a text column.

Slot detectors know the placeholder syntaxes of template languages and of
hand-written forms, and look at every whole text.  A slot that its sentence
talks about is a mention; it doesn't excuse other slots.

Every other answer is judged by a score of five kinds of evidence:

* grammar: how far its sentences are explained by combinations of concepts
  (a thing of the web that failed, scripts that are needed, text that stands in
  for text), whatever their wording;
* surprise: the share of its words that hardly any ordinary record uses;
* mismatch: the share of title and address slug words that it lacks;
* copies: the number of slugs under which the same body stands, if it is of low
  information;
* host: how often its source gives answers that the grammar explains wholly.

No single kind convicts.  A body that the grammar does not know is found once
it stands under several slugs in foreign words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import column_position, numbered_columns, pick
from tessera.session import materialize


def _stems(words: str) -> list[str]:
    """Patterns of words: a trailing hyphen leaves the ending open, a low line stands for a blank."""
    return [w[:-1].replace("_", r"\s+") + r"\p{L}*" if w.endswith("-") else w.replace("_", r"\s+") for w in words.split()]


def _has(words: list[str]) -> str:
    """One pattern for any of the words in a text in lower case; those with the same first letter share a branch, longer ones first."""
    branches: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        branches.setdefault(w[0], []).append(w[1:])
    return r"(?u)(?<!\p{L})(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in branches.items()) + r")(?!\p{L})"


# The concepts of the notice grammar, as words of six languages.
THING = _stems(
    "page pages site website web_site webpage server host gateway service url link address content document file resource request session connection "
    "database record entry list app application reviews comments region country access something module index line function robot captcha human "
    "seite seiten webseite website dienst adresse inhalt- dokument datei ressource anfrage sitzung verbindung datenbank anwendung bewertungen zugriff zugang etwas server- "
    "serveur lien contenu- fichier ressource requête demande connexion base_de_données avis région accès quelque_chose "
    "página sitio servidor servicio enlace dirección contenido archivo recurso solicitud petición sesión conexión base_de_datos aplicación reseñas región acceso algo "
    "serviço endereço conteúdo arquivo ficheiro pedido solicitação sessão conexão ligação aplicação avaliações região acesso "
    "pagina dienst adres inhoud bestand bron verzoek aanvraag sessie verbinding databank toepassing recensies regio toegang iets serverfout artikel article item product artículo artigo produto produit produkt"
)
FAILURE = _stems(
    "not_found can't_find cannot_find couldn't_find could_not_find unavailable not_available not_be_found no_longer not_exist moved removed deleted gone expired timed_out timeout time-out denied refused "
    "forbidden blocked restricted failed failure error errors exception crashed could_not couldn't cannot can't unable down offline maintenance unexpected overloaded "
    "too_many limit exceeded rate_limited unauthorized unauthorised went_wrong bad_request bad_gateway not_allowed not_have_permission don't_have_permission no_permission not_understand not_a_robot unreachable unhandled uncaught fatal out_of_range stack_trace checking verify verifying "
    "nicht_gefunden nicht_verfügbar nicht_erreichbar existiert_nicht gelöscht entfernt verschoben abgelaufen verweigert gesperrt blockiert fehler serverfehler konnte_nicht konnten_nicht kann_nicht können_nicht "
    "nicht_geladen fehlgeschlagen wartung wartungsarbeiten überlastet zeitüberschreitung nicht_mehr unbekannter ungültige- schiefgelaufen schief_gelaufen "
    "introuvable- indisponible- n'existe_pas n'existe_plus supprimé- déplacé- expiré- refusé- interdit- bloqué- erreur erreurs échoué échec maintenance impossible surchargé- délai_dépassé pas_disponible n'a_pas_pu n'ont_pas_pu "
    "no_encontrad- no_disponible- no_está_disponible no_existe eliminad- movid- caducad- caducó expirad- expiró denegad- rechazad- prohibid- bloquead- error errores fallo falló fallado mantenimiento sobrecargad- no_se_pudo no_se_ha_podido no_se_encuentra no_hemos_encontrado "
    "não_encontrad- indisponíve- não_está_disponível não_disponível não_existe removid- expirou negado recusad- proibid- erro erros falha falhou manutenção não_foi_possível não_pôde sobrecarregad- "
    "niet_gevonden niet_beschikbaar niet_bereikbaar bestaat_niet verwijderd verplaatst verlopen geweigerd verboden geblokkeerd fout fouten serverfout mislukt onderhoud overbelast kon_niet konden_niet kan_niet niet_meer tijdelijk_niet"
)
REMEDY = _stems(
    "try_again try_later again_later later please_wait wait reload refresh retry sign_in log_in login back_shortly back_soon come_back slow_down contact administrator "
    "versuchen_sie später erneut neu_laden warten melden_sie anmelden kürze gleich_zurück "
    "réessaye- essayer ultérieurement plus_tard patienter recharge- reconnecter connecter bientôt "
    "inténte- intente- vuelva_a más_tarde espere recargue actualice inicie_sesión pronto "
    "tente_novamente tente mais_tarde aguarde recarregue atualize inicie_sessão novamente breve "
    "probeer later opnieuw wacht even_geduld herlaad ververs log_in meld_u aan snel_terug"
)
SCRIPTS = _stems("java_script javasc- java-script js script scripts scripting skripte cookie cookies browser browser- navigateur navegador")
NEED = _stems(
    "enable- activate- turn_on turned_off turn_it_on switch_on switched_off switch_it_on allow disabled deactivated off blocked require- need needs must support supported "
    "aktivier- deaktivier- einschalten erlauben benötigt erforderlich ausgeschaltet abgeschaltet unterstützt "
    "activer activez désactivé- nécessaire nécessite besoin autoriser requis "
    "active activar activado habilit- desactivad- necesita necesario requiere permita "
    "ative ativar ativado desativad- desabilitad- precisa necessário requer permita "
    "schakel inschakelen ingeschakeld uitgeschakeld activeer nodig vereist vereisen"
)
STAND_IN = _stems(
    "placeholder dummy filler sample example test lorem blindtext platzhalter- beispiel- testbewertung testtext mustertext blind- füll- fülltext remplissage exemple essai ejemplo relleno prueba marcador_de "
    "exemplo preenchimento teste voorbeeld- opvul- opvultekst testtekst testrecensie plaatshouder provisoire provisional provisório tijdelijke"
)
COPY = _stems(
    "text copy content review description paragraph body words sentence text- inhalt bewertung beschreibung absatz texte avis contenu paragraphe description texto reseña contenido párrafo descripción opinión "
    "avaliação conteúdo parágrafo descrição tekst recensie beoordeling inhoud alinea beschrijving blindtext beispieltext testbewertung testtext mustertext platzhaltertext fülltext voorbeeldtekst opvultekst testtekst testrecensie"
)
ASKS = _stems(
    "write type enter insert replace add put goes_here follows follow comes_here be_added coming_soon publish ignore here hier ici aquí aqui schreib- eingeben einfüg- ersetz- folgt steht kommt ignorieren veröffentlichen "
    "écri- saisi- insér- remplac- ajout- ignor- publi- escrib- introdu- insert- sustitu- reemplaz- añad- escrev- digit- insir- substitu- adicion- schrijf- typ voer vervang- voeg komt negeren publiceren"
)
# Words of the closed classes and of forms, which a notice may have besides its concepts.
PLAIN_WORDS = _stems(
    "a an the this that these it its is are was were be been being has have had do does did not no or and but of on in to for from by with at as if so we you your our us please sorry oops "
    "unfortunately currently now again right temporarily permanently internal end id code number reference ref ticket incident http https status here there who what when which will would may might can should could than then "
    "some something anything nothing all any only before after until while soon later soon moment moments minutes few valid access permission view see show shown look looking find found load loaded loading display displayed open read run sent send work works properly continue condition conditions exist exists trace moment "
    "dies existiert der die das den dem des ein eine einen einem ist sind war wurde wurden wird werden und oder aber von im in zu zum zur für mit auf aus bei bitte leider derzeit momentan vorübergehend hier sie ihr ihre ihrem ihren ihrer diese dieser dieses diesen es wir nicht kein keine um sehen angezeigt angeforderte angeforderten geladen seite interner interne zugriff vorgang referenz als später wenigen minuten augenblick eigenen durch dort wieder da "
    "ceci existe le la les l un une des du de d et ou mais est sont a été sera à au aux en pour par avec sur dans ce cet cette ces vous votre vos nous notre veuillez désolé désolée malheureusement actuellement momentanément ici ne n pas plus accès code référence afficher voir charger demandé- interne fonctionner qu que être avant c s y il elle "
    "esto está están estamos el los las una unos y o pero es son fue ha han sido será al del en para por con sobre su sus este esta estos nuestra nuestro por_favor lo_sentimos lamentablemente actualmente temporalmente momento aquí no se le que acceso código referencia ver mostrar cargar solicitad- interno se_ha "
    "isto está estão estamos o os as um uma e ou mas são foi será ao do da dos das no na nos nas em para por com sobre seu sua seus este esta por_favor desculpe infelizmente atualmente temporariamente aqui não se lhe que acesso código referência ver mostrar carregar solicitad- interno "
    "dit bestaat het een de en of maar is zijn was werd wordt worden van in op te voor met aan bij door uw jouw deze dit wij we niet geen er helaas momenteel tijdelijk hier om toegang code referentie bekijken tonen laden opgevraagde interne gevraagde dat die u je alstublieft sorry"
)
# The classes of status codes as servers print them, and their standard short names.
STATUS = r"(?:http|error|fehler|erreur|erro|fout|status|code)\W{0,3}(?:\d{1,2}\.\d\W+)?[45]\d\d|\b[45]\d\d\b\W{0,3}(?:error|fehler|erreur|erro|fout)|" + (
    r"\b[45]\d\d\W{0,3}(?:bad|unauthori[sz]ed|payment|forbidden|not|method|proxy|request|conflict|gone|length|precondition|payload|uri|range|expectation|misdirected|"
    r"unprocessable|locked|failed|too|upgrade|unavailable|internal|service|gateway|variant|insufficient|loop|network)\b"
)
EXPLAINED = _has(THING + FAILURE + REMEDY + SCRIPTS + NEED + STAND_IN + COPY + ASKS + PLAIN_WORDS)
# The vocabulary of the usual filler text.
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute "
    "irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non "
    "proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
# Stand-in words that fill a field when they are all it has.
STAND_INS = "xxx xx x text texte texto tekst test teste testing foo bar baz qux blah bla asdf asdfgh qwerty qwertz lorem ipsum sample dummy filler abc".split()
# What says that something is not needed.
NEEDLESS = (
    r"(?u)\b(?:not|n't|never)\s+(?:need|require)|(?<!\p{L})(?:ne nécessite pas|no necesita|no requiere|não precisa|não requer)(?!\p{L})|"
    r"\b(?:benötigt|braucht|benötigen)\s+kein|\bgeen\b.*\bnodig\b"
)
# What notices and filler have: one of these, or two of the concepts that combine.
FILLER_CUES = _has(SCRIPTS + STAND_IN + STAND_INS + [w for w in FILLER_WORDS if len(w) > 4])
VOCABULARY = _has(THING + FAILURE + REMEDY + SCRIPTS + NEED + STAND_IN + COPY + ASKS + PLAIN_WORDS + STAND_INS + FILLER_WORDS)
# Page navigation and labels around a body.
NAVIGATION = (
    r"(?iu)(\b[\p{L}']+(?: [\p{L}']+)?(?:\s*[|›»>·]\s*[\p{L}']+(?: [\p{L}']+)?)+|\bback to (?:the )?home ?page\b|\bcontact support\b|"
    r"\bmenu\s+search\s+sign in\b|\bzurück zur startseite\b|\bretour à l'accueil\b|\bvolver al inicio\b|"
    r"\bvoltar ao início\b|\bterug naar (?:de )?(?:home|start)(?:pagina)?\b|^\s*(?:review|title|text)\s*:)"
)
MARKUP = r"(?iu)</?(?:h\d|p|br|hr|div|span|noscript|b|i|u|em|strong|a|ul|ol|li|body|html|head|title|section|main|nav|footer|header|script|style|table|tr|td|th|img)\b[^<>]*>"

# Placeholder syntaxes that are never prose.
_NAME = r"[\p{L}_][\p{L}\p{N}_.]*"
PAIRED_SLOTS = [
    # Delimiter pairs with any content: helpers, filters, indexes, defaults, blocks.
    r"\{\{(?=[^{}]*[\p{L}_])(?:[^{}]++|\{[^{}]*+\})++\}\}",
    r"[$#]\{(?=[^{}]*[\p{L}_])(?:[^{}]++|\{[^{}]*+\})++\}",
    r"<%(?=[^<>]*[\p{L}_])(?s:.)+?%>",
    r"<%=?\s*[^<>%]{1,60}%>",
    r"<\?(?=php|=|\s*[\p{L}_$])(?s:.)+?\?>",
    r"\{%[-+]?\s*\p{L}(?s:.)*?%\}",
    r"\{#\s*\p{L}(?s:.)*?#\}",
]
CODE_SLOTS = PAIRED_SLOTS + [
    r"%\(\s*[\p{L}_][^()\s]*\s*\)[-+# 0]?\d*(?:[sd]|\.\d+f)",
    # Dotted, hyphenated, indexed or filtered names in single braces.
    r"\{\s*" + _NAME + r"(?:\[[^\[\]{}]*\]|[-.][\p{L}_][\p{L}\p{N}_]*)+\s*(?:\|[^{}]*)?\}",
    r"\{\s*[\p{L}_][\p{L}\p{N}_]*\s*\|\s*[\p{L}_]+(?:[:(][^{}]*)?\s*\}",
    r"(?<![\p{L}\p{N}])%(?:\d{1,2}\$)?s\b",
    r"(?<![\p{L}\p{N}:/]):[\p{Ll}]+(?:_[\p{Ll}\p{N}]+)+\b",
    r"\[\[\s*[\p{L}_][^\[\]]{0,60}\]\]",
    r"<<\s*[\p{L}_][^<>]{0,60}>>",
    r"##\s*[\p{L}_][\p{L}\p{N}_. -]{1,60}##",
    r"@@\s*[\p{L}_][\p{L}\p{N}_. -]{1,60}@@",
    r"__[\p{L}][\p{L}\p{N}_]{1,60}?__",
    r"\*\|[\p{L}_][^|*\n]*\|\*",
    r"\|[\p{Lu}_][\p{Lu}\p{N}_]{2,60}\|",
    r"\$[\p{Lu}_][\p{Lu}\p{N}_]{2,60}\$",
    r"%[\p{L}_][\p{L}\p{N}_-]{2,60}%",
    r"\{\d{1,2}\}",
    r"«[\p{L}_][\p{L}\p{N}_]*(?: [\p{L}\p{N}_]+){0,3}»",
]
# Words of a form that ask the writer to fill something in.
FILL_IN = (
    r"(?iu)^(?:insert|enter|add|type|choose|your|hier|ihre?|einfügen|insertar|inserte|introduzca|añadir|su|sus|tu|inserir|insira|seu|sua|"
    r"insérer|insérez|ajouter|votre|vos|invoegen|vul|voeg|uw|jouw)\b.{1,60}$|"
    r"^.{1,60}\b(?:here|goes here|hier|einfügen|eintragen|einsetzen|ici|aquí|aqui|invullen|invoegen)$"
)
# Names of form fields, as one or several words.
FIELD_WORDS = (
    r"(?iu)^(?:(?:first|last|full|customer|user|product|brand|item|order|discount|store|shop|city|town|colour|color|feature|date|purchase|"
    r"company|reviewer|name|id|code|number|of|price|"
    r"vorname|nachname|kundenname|produktname|marke|farbe|filiale|kaufdatum|bestellnummer|stadt|"
    r"prénom|nom|du|de|produit|marque|couleur|magasin|ville|commande|"
    r"nombre|del|producto|marca|tienda|ciudad|pedido|"
    r"voornaam|naam|productnaam|merk|kleur|winkel|stad|"
    r"nome|do|produto|cor|loja|cidade)(?:\s+|$)){1,4}\d*$"
)
# Field names joined by hyphens in square brackets; other hyphenated words there are asides.
HYPHENATED = FIELD_WORDS.replace("(?:\\s+|$)", "(?:-|$)").replace("customer|", "customer|user|email|delivery|shipping|phone|model|")
# An opening bracket before a request to fill in, even if it is never closed.
OPEN_SLOT = (
    r"(?iu)[\[{]\s*(?:insert|enter|add|your|hier\s+\p{L}+(?:\s+\p{L}+)?\s+ein\w+|ihre?|insertar|inserir|insérer|votre|su|seu|uw)\s+\p{L}{3,}|"
    r"[\[{]\s*\p{L}+(?:\s+\p{L}+){0,2}\s+(?:einfügen|eintragen|invullen|goes here)\b"
)
# Single bracketed words that writers use as asides.
ASIDES = (
    r"(?iu)^(?:update|updated|edit|edited|sic|note|spoiler|nachtrag|anmerkung|hinweis|actualización|nota|mise|màj|ajout|"
    r"atualização|naschrift|opmerking|haha|lol|laughs|smile|sigh|ironie|irony|sarcasm)$"
)
# Words of a sentence that talks about placeholders.
MENTION = (
    r"(?iu)\b(software|app settings|settings|einstellungen|serienbrief\w*|merge fields?|mail merge|csv|import|array keys?|template|"
    r"templates|vorlagen?|plantillas?|modèles? de|gabarits?|sjablo\w+|placeholders?|platzhalter|variables?|syntax|"
    r"filled (?:in|out)|ajustes|réglages|paramètres|instellingen|definições|configurações|fusion|combinar|"
    r"correspondencia|champs?|campos?|velden|felder|seriebrief\w*|editor|script language|programming|source code)\b"
)
# A placeholder of any syntax, and several in a row.
_ANY_SLOT = (
    r"(?:\{\{[^{}]*\}\}|[$#]\{[^{}]*\}|<%[^%]*%>|\{%[^%]*%\}|<\?[^?]*\?>|%\([^()]*\)[sd]|%(?:\d{1,2}\$)?s\b|\[\[[^\[\]]*\]\]|<<[^<>]*>>|"
    r"##[^#\n]*##|@@[^@\n]*@@|__\p{L}[\p{L}\p{N}_]*?__|\*\|[^|]*\|\*|\|[\p{Lu}_]+\||\$[\p{Lu}\p{N}_]+\$|%\p{L}[\p{L}\p{N}_-]*%|"
    r"\[[^\[\]]{1,70}\]|\{[^{}]{1,70}\}|<[^<>]{1,70}>|«[^»]{1,60}»)"
)
_SLOT_RUN = _ANY_SLOT + r"(?:(?:\s*[,/]\s*|\s+)(?:(?:or|and|oder|und|ou|et|y|o|e|of|en)\s+)?" + _ANY_SLOT + ")*"
_SUCH_AS = r"(?:\s+(?:such as|like|named|called|e\.g\.|for example|wie|namens|z\.\s?B\.|comme|tels que|telles que|como|zoals|genaamd|bijvoorbeeld))"
_QUOTE = r"[\"'`„“”‘’]"
# Nouns for placeholders that govern the slot after or before them.
NAMED_SLOT = (
    r"(?iu)\b(?:(?:merge fields?|merge tags?|array keys?|placeholders?|platzhalter\p{L}*|variables?|variablen?|variabelen|variáve(?:l|is)|shortcodes?|syntax|"
    r"seriendruckfeld(?:er)?)" + _SUCH_AS + r"?|(?:fields?|keys?|tags?|feld(?:er)?|champs?|balises?|campos?|etiquetas?|veld(?:en)?)(?:\s+(?:de|del|da|do)\s+\p{L}+)?"
    + _SUCH_AS + r")\s+" + _QUOTE + "?" + _SLOT_RUN + "|" + _SLOT_RUN + _QUOTE + r"?\s+(?:merge fields?|merge tags?|placeholders?|platzhalter|variables?|syntax)\b"
)
# Verbs of typing and of filling in that govern a slot, where the sentence has a word of MENTION.
HANDLED_SLOT = (
    r"(?iu)(?:(?<!\b(?:this|that|the|each)\s)\b(?:typ(?:e|es|ed|ing|t|en)|enter(?:s|ed|ing)?|insert(?:s|ed|ing)?|tipp\p{L}*|eingeben|gibt|gebe|tape[rz]?|saisi\p{L}*|"
    r"teclea\p{L}*|escrib\p{L}+|digit\p{L}+)(?:\s+(?:man|ich|du|wir|je|ik|men|u))?|"
    r"\b(?:setzt|fügt|füllt|ersetzt|fills|substitutes|replaces|remplace|insère|sustituye|inserta|vervangt|vult|substitui|insere)"
    r"(?:\s+(?:(?:die|das|der|the|le|la|el|de|het|o)\s+)?\p{L}+)?)\s+" + _QUOTE + "?" + _SLOT_RUN + "|"
    + _QUOTE + _SLOT_RUN + _QUOTE + "|"
    + _SLOT_RUN + r"\s+(?:(?:was|were|is|are|gets?|got|wird|werden|wurden?)\s+)?(?:filled in|richtig ein|korrekt ein|"
    r"(?:replaced|substituted) (?:by|with)|(?:ersetzt|remplacée?s?|sustituid[oa]s?|vervangen|substituíd[oa]s?) (?:durch|par|por|door))\b"
)
# Where a sentence or paragraph ends, without taking anything from the text.
PASSAGE_END = r"(?<=[.!?…])(?=\s)|(?<=\n)(?=\s*\n)"
# Words of a writer who tells of themselves.
TELLING = (
    r"(?iu)\b(i|i'm|my|mine|me|ich|mein\w*|mich|mir|je|mon|ma|mes|moi|mi|mis|yo|ik|mijn|mij|eu|meu|minha|sister|brother|father|mother|"
    r"colleague|neighbour|kids|flatmate)\b"
)
SENTENCE_END = r"(?<=[.!?…])\s+|\s*[\r\n]+\s*|(?<=\.\.\.)"


# Where a text may have a slot at all.
SLOT_MARKS = r"[\[\]{}<>%#@$«|*]|__|!!|:\p{Ll}+_"


@dataclass(frozen=True)
class ResidueRules:
    """Weights of the evidence and the bounds of its kinds."""

    threshold: float = 3.0  # score that convicts
    grammar_weight: float = 2.0
    surprise_weight: float = 2.5
    copies_weight: float = 1.0
    mismatch_weight: float = 0.5
    host_weight: float = 0.5
    sentence_share: float = 0.8  # of a sentence's words that the grammar knows
    few_words: int = 4  # own words a text may have beside its notices; twice as many leave no grammar evidence
    full_copies: int = 3  # slugs with the same body that count in full; from two on they count
    low_information: int = 60  # distinct words up to which copies count
    short_words: int = 3  # distinct words from which they do: shorter texts are merely short
    ordinary_rate: float = 0.0005  # share of the ordinary records that use a word, up to which it is foreign
    host_rate: float = 0.001  # share of a source's records that the grammar explains, from which it counts


def _restored(text: Column) -> Column:
    """Text with its escaped angle brackets restored."""
    return F.regexp_replace(F.regexp_replace(text, "(?i)&lt;", "<"), "(?i)&gt;", ">")


def _plain(text: Column) -> Column:
    """Text without mark-up, escaped angle brackets restored."""
    return F.regexp_replace(_restored(text), MARKUP, "\n")


def _any_of(text: Column, patterns: list[str]) -> Column:
    """Whether a text has any of the patterns, which all begin with a mark: places without one are passed over."""
    return text.rlike(r"(?u)(?=[$#{<%\[@_*|:«])(?:" + "|".join(patterns) + ")")


def _has_slot(text: Column) -> Column:
    """Whether a whole text has a slot; slots may span lines, but asterisks begin list items as well and only pair up on one line."""
    code = _any_of(text, CODE_SLOTS)
    # A bracket may be wrapped, but doesn't go on in another paragraph.
    paired = F.regexp_extract_all(text, F.lit(r"(?u)[\[{<]\s*([\p{L}_][^\[\]{}<>*]{0,70}?)\s*[\]}>]"), 1)
    starred = F.regexp_extract_all(text, F.lit(r"(?u)[\[{<*][ \t]*([\p{L}_][^\[\]{}<>*\r\n]{0,70}?)[ \t]*[\]}>*]"), 1)
    inner = F.transform(F.filter(F.concat(paired, starred), lambda x: ~x.rlike(r"\n\s*\n")), lambda x: F.regexp_replace(x, r"\s+", " "))
    worded = F.exists(
        inner,
        lambda x: x.rlike(FILL_IN)
        | x.rlike(r"(?u)^[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)+$")
        | x.rlike(r"(?u)^\p{Lu}\p{Ll}+(?:\p{Lu}[\p{Ll}\p{N}]+)+$")
        | x.rlike(FIELD_WORDS)
        | (x.contains("-") & x.rlike(HYPHENATED)),
    )
    angled = text.rlike(r"(?u)<\s*[\p{L}_][\p{L}\p{N}_]*(?:-[\p{L}\p{N}_]+)+\s*>")
    single = F.exists(
        F.regexp_extract_all(text, F.lit(r"(?u)[\[{<]\s*(\p{Lu}[\p{Lu}\p{N} _]{2,60})\s*[\]}>]"), 1),
        lambda x: ~x.rlike(ASIDES),
    )
    shouted = F.exists(F.regexp_extract_all(text, F.lit(r"(?u)!!\s*([\p{Lu}_ ]{3,60}?)\s*!!"), 1), lambda x: F.regexp_replace(x, "_", " ").rlike(FIELD_WORDS))
    return code | worded | angled | single | shouted | text.rlike(OPEN_SLOT)


def _without_mentions(plain: Column) -> Column:
    """Plain text without the slots that their sentence talks about; all other slots stay."""

    def strip(s: Column) -> Column:
        unnamed = F.regexp_replace(s, NAMED_SLOT, " ")
        return F.when(s.rlike(MENTION), F.regexp_replace(unnamed, HANDLED_SLOT, " ")).otherwise(unnamed)

    return F.array_join(F.transform(F.split(plain, PASSAGE_END), lambda s: F.when(s.rlike(r"[\[\]{}<>%#@$«_|*]"), strip(s)).otherwise(s)), "")


def _body(plain: Column) -> Column:
    """Plain text without navigation, blanks reduced."""
    body = F.regexp_replace(plain, r"[ \t\u00a0]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, NAVIGATION, "\n"), r"(?u)\s*\n\s*", "\n"))


def _form(text: Column) -> Column:
    """A text's words in lower case, one blank between them, without those that have digits: numbers and codes don't part copies."""
    lettered = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}])\p{L}*+\p{N}[\p{L}\p{N}]*+", " ")
    return F.trim(F.regexp_replace(lettered, r"[^\p{L}]+", " "))


def _words(form: Column) -> Column:
    return F.when(form == "", F.array().cast("array<string>")).otherwise(F.split(form, " "))


def _records(documents: DataFrame, text: str = "text", title: str = "title", slug: str = "item_id", host: str = "source", key: str = "doc_id") -> DataFrame:
    """``key, text, title, slug, host`` of every record."""
    return pick(documents, key, text, title, slug, host).select(
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        F.coalesce(F.col(title), F.lit("")).alias("title"),
        F.coalesce(F.col(slug).cast("string"), F.lit("")).alias("slug"),
        F.lower(F.trim(F.coalesce(F.col(host), F.lit("")))).alias("host"),
    )


def _count(text: Column) -> Column:
    return F.size(_words(_form(text)))


def _grammar(plain: Column, rules: ResidueRules) -> Column:
    """How far a plain text in lower case is made of notice and filler sentences: 1 for wholly, but for a few words."""

    def judged(sentence: Column) -> Column:
        thing, fails, remedy, needs, scripts, dummy, copy, asks = (sentence.rlike(_has(v)) for v in (THING, FAILURE, REMEDY, NEED, SCRIPTS, STAND_IN, COPY, ASKS))
        combined = (
            (fails & (thing | remedy)) | (scripts & (needs | fails)) | (dummy & (copy | asks)) | (copy & asks) | sentence.rlike("(?u)" + STATUS)
        )
        words = _words(_form(sentence))
        n = F.size(words)
        unknown = _count(F.regexp_replace(sentence, EXPLAINED, " "))
        filling = F.size(F.filter(words, lambda w: w.isin(FILLER_WORDS)))
        repeated = (n >= 2) & (F.size(F.array_distinct(words)) <= 2) & F.forall(words, lambda w: w.isin(STAND_INS))
        # Variants of the usual filler are named after it: "... ipsum ...".
        named = sentence.rlike(r"(?u)^\W*(?:\p{L}+\W+)?ipsum\b")
        told = sentence.rlike(TELLING)
        filler = repeated | named | ((n >= 3) & (filling >= 0.75 * n))
        known = (n > 0) & (unknown <= (1 - rules.sentence_share) * n + 1e-9)
        return F.struct(n.alias("n"), (~told & (filler | (combined & known & ~sentence.rlike(NEEDLESS)))).alias("notice"), (~told & known).alias("known"))

    allowed = 2 * rules.few_words
    sentences = F.transform(F.filter(F.split(_body(plain), SENTENCE_END), lambda s: s.rlike(r"(?u)[\p{L}\p{N}]")), judged)

    def weigh(judgement: Column) -> Column:
        found = F.exists(judgement, lambda s: s["notice"])
        # A sentence of known words need not be a notice itself beside one.
        own = F.aggregate(judgement, F.lit(0), lambda total, s: total + F.when(s["notice"] | s["known"], 0).otherwise(s["n"]))
        return F.when(found, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 - own / F.lit(float(rules.few_words))))).otherwise(0.0)

    # Only texts with a cue, and with few enough words outside the whole vocabulary, can be more than 0: the others are not taken apart.
    cue = (
        plain.rlike(FILLER_CUES)
        | (plain.rlike(_has(FAILURE)) & plain.rlike(_has(THING + REMEDY)))
        | (plain.rlike(_has(ASKS)) & plain.rlike(_has(COPY)))
        | (plain.rlike("[45][0-9][0-9]") & plain.rlike("(?u)" + STATUS))
    )
    at_most = F.size(F.split(plain, r"[^\p{L}]+"))
    unknown = _count(F.regexp_replace(plain, VOCABULARY, " "))
    navigation = plain.rlike(r"(?u)(?<!\p{L})ipsum(?!\p{L})|[|›»>·]")
    possible = cue & ((unknown <= allowed + (1 - rules.sentence_share) * at_most) | navigation)
    return F.when(possible, F.element_at(F.transform(F.array(sentences), weigh), 1)).otherwise(0.0)


def answer_evidence(documents: DataFrame, rules: ResidueRules = ResidueRules(), **columns: str) -> DataFrame:
    """What each record with a text says of itself.

    ``key, host, slug, has_slot, grammar, mismatch, body, n_words, terms``:
    ``body`` is the hash of the text's form, ``n_words`` the number of its
    distinct words; these are kept as ``terms`` for bodies of low information
    and for those the grammar knows.
    """
    base = _records(documents, **columns).where("text is not null")
    # Slots are sought in the whole text, as they may hold line breaks and ends of sentences; those of mark-up in the text with it.
    marked = F.col("plain") != F.col("restored")
    slots = F.col("restored").rlike(SLOT_MARKS) & (
        _has_slot(F.col("talked")) | (marked & _any_of(_without_mentions(F.col("restored")), PAIRED_SLOTS))
    )
    asked = F.array_distinct(_words(_form(F.concat_ws(" ", "title", "slug"))))
    lacking = F.size(F.array_except(F.col("asked"), F.col("words")))
    return (
        base.withColumn("restored", F.when(F.col("text").contains("&"), _restored(F.col("text"))).otherwise(F.col("text")))
        .withColumn("plain", F.when(F.col("restored").contains("<"), _plain(F.col("text"))).otherwise(F.col("restored")))
        .withColumn("talked", F.when(F.col("plain").rlike(SLOT_MARKS), _without_mentions(F.col("plain"))).otherwise(""))
        .withColumn("has_slot", slots)
        .withColumn("form", _form(F.col("text")))
        .withColumn("words", F.array_distinct(_words(F.col("form"))))
        .withColumn("asked", asked)
        .withColumn("grammar", _grammar(F.lower(F.col("plain")), rules))
        .withColumn("n_words", F.size("words"))
        .select(
            "key",
            "host",
            "slug",
            "has_slot",
            "grammar",
            F.when(F.size("asked") == 0, 1.0).otherwise(lacking / F.size("asked")).alias("mismatch"),
            F.xxhash64("form").alias("body"),
            "n_words",
            F.when((F.col("n_words") <= rules.low_information) | (F.col("grammar") > 0), F.col("words")).alias("terms"),
        )
    )


def copied_bodies(answers: DataFrame) -> DataFrame:
    """``body, n_slugs, n_records`` of the bodies that stand under several slugs; those without words aside."""
    per_slug = answers.where("n_words > 0").groupBy("body", "slug").agg(F.count(F.lit(1)).alias("n"))
    return per_slug.groupBy("body").agg(F.count(F.lit(1)).alias("n_slugs"), F.sum("n").alias("n_records")).where("n_slugs > 1")


def foreign_words(bodies: DataFrame, answers: DataFrame, documents: DataFrame, rules: ResidueRules, **columns: str) -> DataFrame:
    """``body, surprise``: the share of a body's words that hardly any ordinary record uses in title or text.

    ``bodies(body, terms, n_records)``.  Ordinary are the records in which the
    grammar sees nothing; the body's own records don't count either.
    """
    records = _records(documents, **columns)
    used = records.select(F.explode(F.array_distinct(_words(_form(F.concat_ws(" ", "title", "text"))))).alias("word"))
    noticed = answers.where("grammar > 0").select(F.explode("terms").alias("word"))
    # Counts are combined before the shuffle; a word of every record is one row a task.
    uses = used.groupBy("word").agg(F.count(F.lit(1)).alias("n")).unionByName(noticed.groupBy("word").agg((-F.count(F.lit(1))).alias("n")))
    uses = uses.groupBy("word").agg(F.sum("n").alias("n"))
    ordinary = documents.count() * rules.ordinary_rate
    words = bodies.select("body", "n_own", F.explode("terms").alias("word"))
    foreign = F.col("n") - F.col("n_own") <= F.lit(ordinary)
    return words.join(uses, "word").groupBy("body").agg(F.avg(foreign.cast("int")).alias("surprise"))


def residue_scores(documents: DataFrame, rules: ResidueRules = ResidueRules(), **columns: str) -> DataFrame:
    """``key, has_slot, grammar, surprise, mismatch, n_slugs, host_rate, score`` of the records that could be cases.

    These have a slot, a sentence that the grammar knows, or a body of low
    information that stands under several slugs.
    """
    answers = materialize(answer_evidence(documents, rules, **columns), "residue-answers")
    copies = copied_bodies(answers)
    low = F.col("n_words").between(rules.short_words, rules.low_information)
    # Counting by host is combined before the shuffle, too.
    hosts = answers.groupBy("host").agg(F.avg((F.col("grammar") == 1).cast("int")).alias("host_rate"))
    seen = answers.join(copies, "body", "left").where((F.col("has_slot")) | (F.col("grammar") > 0) | (F.col("n_slugs").isNotNull() & low))
    seen = materialize(seen.join(hosts, "host"), "residue-candidates")
    # Records that the grammar knows are no ordinary ones: only of the others the own ones are taken off.
    own = F.when(F.first("grammar") > 0, F.lit(0)).otherwise(F.coalesce(F.first("n_records"), F.lit(1)))
    bodies = seen.where("terms is not null").groupBy("body").agg(F.first("terms").alias("terms"), own.alias("n_own"))
    surprise = foreign_words(bodies, answers, documents, rules, **columns)
    copied = F.when(low, F.least(F.lit(1.0), (F.coalesce("n_slugs", F.lit(1)) - 1) / F.lit(rules.full_copies - 1))).otherwise(0.0)
    score = (
        rules.grammar_weight * F.col("grammar")
        + rules.surprise_weight * F.col("surprise")
        + rules.copies_weight * copied
        + rules.mismatch_weight * F.col("mismatch")
        + rules.host_weight * (F.col("host_rate") >= rules.host_rate).cast("int")
    )
    scored = seen.join(surprise, "body", "left").withColumn("surprise", F.coalesce("surprise", F.lit(0.0)))
    return scored.select("key", "has_slot", "grammar", "surprise", "mismatch", F.coalesce("n_slugs", F.lit(1)).alias("n_slugs"), "host_rate", score.alias("score"))


def find_residue(documents: DataFrame, rules: ResidueRules = ResidueRules(), **columns: str) -> DataFrame:
    """Records whose text is template residue, filler, an error page or a script notice.

    Returns ``key, kind`` and the evidence ``grammar, surprise, mismatch,
    n_slugs, host_rate, score``; ``kind`` is ``slot`` for unfilled template
    slots anywhere in the text, else ``notice`` where the grammar knows a
    sentence and ``response`` where the other evidence convicts alone.

    Null, empty and merely short texts are no cases.  Titles only serve as
    evidence.  Repeated keys are judged one by one.  Texts are read whole, and
    copies and words are counted over all records; extra columns are ignored.
    An answer that the grammar does not know is only found if it stands under
    several slugs of a source that gives notices.
    """
    host = (F.col("grammar") > 0) | (F.col("host_rate") >= rules.host_rate)
    scored = residue_scores(documents, rules, **columns).where(F.col("has_slot") | ((F.col("score") >= rules.threshold) & host))
    kind = F.when(F.col("has_slot"), "slot").when(F.col("grammar") > 0, "notice").otherwise("response")
    return scored.select("key", kind.alias("kind"), "grammar", "surprise", "mismatch", "n_slugs", "host_rate", "score")


def without_residue(documents: DataFrame, key: str = "doc_id", **kwargs) -> DataFrame:
    """The remaining records, with all their columns."""
    found = find_residue(documents, key=key, **kwargs).select(F.col("key").alias("_found"))
    own_key = F.col(f"_c{column_position(documents, key)}")
    return numbered_columns(documents).join(found, own_key.eqNullSafe(F.col("_found")), "left_anti").toDF(*documents.columns)
