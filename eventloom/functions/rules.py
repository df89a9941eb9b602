"""Word lists, rule tables and patterns, in their order of precedence.

They describe the domain (a German city's events) and must be these for the results to be right. Patterns are
read against slugs (lower-case ASCII words joined by "-") unless a name says otherwise.
"""

# Categories.
RAW_CATEGORIES = (
    ("musik", "musik"), ("konzert", "musik"), ("konzerte", "musik"), ("party", "musik"), ("club", "musik"), ("dj",
    "musik"), ("rave", "musik"), ("buehne", "kultur"), ("bühne", "kultur"), ("theater", "kultur"), ("oper",
    "kultur"), ("ballett", "kultur"), ("kunst", "kultur"), ("ausstellung", "kultur"), ("lesung", "kultur"),
    ("vortrag", "kultur"), ("gespraech", "kultur"), ("kabarett", "kultur"), ("film", "kultur"), ("kino", "kultur"),
    ("diskussion", "kultur"), ("literatur", "kultur"), ("kinder", "familie"), ("familie", "familie"), ("fuehrung",
    "fuehrungen"), ("fuehrungen", "fuehrungen"), ("rundgang", "fuehrungen"), ("entdeckungen", "fuehrungen"),
    ("markt", "outdoor"), ("sport", "sport"), ("fitness", "sport"), ("bewegung", "sport"), ("kundgebung", "demo"),
)

TITLE_KEYWORDS = (
    ("filmmusik", "musik"), ("film", "kultur"), ("kino", "kultur"), ("konzert", "musik"), ("musik", "musik"),
    ("party", "musik"), ("dj", "musik"), ("disco", "musik"), ("band", "musik"), ("sound", "musik"), ("session",
    "musik"), ("jamsession", "musik"), ("-rave", "musik"), ("techno", "musik"), ("openair", "musik"), ("open-air",
    "musik"), ("nachtwaechter", "fuehrungen"), ("nacht", "musik"), ("night", "musik"), ("invites", "musik"),
    ("vinyl", "musik"), ("tanztheater", "kultur"), ("philharmon", "musik"), ("sinfoni", "musik"), ("orchester",
    "musik"), ("klassik", "musik"), ("jazz", "musik"), ("blues", "musik"), ("swing", "musik"), ("soul", "musik"),
    ("chor", "musik"), ("liederabend", "musik"), ("tanz", "musik"), ("theater", "kultur"), ("oper", "kultur"),
    ("ballett", "kultur"), ("buehne", "kultur"), ("figurentheater", "kultur"), ("kabarett", "kultur"), ("revue",
    "kultur"), ("ausstellung", "kultur"), ("galerie", "kultur"), ("vernissage", "kultur"), ("schauspiel", "kultur"),
    ("premiere", "kultur"), ("komoedie", "kultur"), ("zirkus", "kultur"), ("kulturtage", "kultur"), ("kinder",
    "familie"), ("familie", "familie"), ("stadtrundfahrt", "fuehrungen"), ("schiff", "fuehrungen"),
    ("schloesserfahrt", "fuehrungen"), ("stadtfahrt", "fuehrungen"), ("elbfahrt", "fuehrungen"), ("dampfer",
    "fuehrungen"), ("besichtigung", "fuehrungen"), ("audioguide", "fuehrungen"), ("schauwerkstatt", "kultur"),
    ("museum", "kultur"), ("sonderausstellung", "kultur"), ("vortrag", "kultur"), ("lesung", "kultur"), ("workshop",
    "kultur"), ("matinee", "kultur"), ("orgel", "musik"), ("messe-in", "musik"), ("messe", "outdoor"), ("fest",
    "outdoor"), ("markt", "outdoor"),
)

TOUR = r"tour(?:-|$)"

TOUR_NOT = (
    r"tour-?(?:19|20)\d{2}|tour-\d{1,2}(?:-|$)|jubilaeumstour|anniversary|tournee|deutschlandtour|(?:^|"
    r"-)auf-tour|(?:^|-)on-tour"
)

TOUR_MUSIC_VENUE = (
    r"(?:^|-)chemiefabrik(?:-|$)|theater-am-wettiner-platz|(?:^|-)beatpol(?:-|$)|dixiebahnhof-dresden|"
    r"(?:^|-)ostpol(?:-|$)|(?:^|-)puschkin(?:-|$)|(?:^|-)tante-ju(?:-|$)"
)

SPORT = (
    r"yoga|pilates|qi-?gong|tai-?chi|taiji|zumba|aerobic|gymnastik|faszien|calisthenics|crossfit|bootcamp|"
    r"workout|fitness|nordic-walking|marathon|triathlon|duathlon|jogging|schwimmkurs|schwimmen|hatha|"
    r"vinyasa|kundalini|ashtanga|iyengar|(?:^|-)asana|(?:^|-)(?:tanzkurs|tanzworkshop|tanzstunde|"
    r"tanztreff|tanzschule)|meditat|(?:^|-)atem(?:workshop|kurs|uebung|training|reise)|feldenkrais|"
    r"alexandertechnik|(?:^|-)entspannungs(?:kurs|training)|rueckbildung|beckenboden|wassergymnastik|"
    r"aquafitness|aquajogging|(?:^|-)(?:tischtennis|badminton|federball|slackline|parkour|discgolf)|(?:^|"
    r"-)(?:stadtradeln|radtreff|feierabendrunde)|(?:^|-)bogenschiessen|(?:^|-)(?:rueckenfit|rueckenschule|"
    r"lauftreff|laufgruppe|laufkurs)|(?:^|-)(?:fahr)?rad(?:tour|touren|ausfahrt|fahrt|rundfahrt|korso|"
    r"nacht|demo)|(?:^|-)(?:radeln|critical-mass|sternfahrt)|(?:^|-)wander(?:ung|ungen|n|tour|touren)(?:-|"
    r"$)|(?:^|-)(?:klettern|kletterkurs|klettertreff|bouldern|boulder-)|(?:^|-)(?:kanu|kajak|paddeln|"
    r"paddel-|rudern|drachenboot)|(?:^|-)(?:skaten|skate-|inline|inliner|rollschuh)|(?:^|-)sport(?:fest|"
    r"tag|treff|kurs|angebot|abzeichen)|(?:^|-)(?:mitmachsport|breitensport|volkssport)|(?:^|"
    r"-)[a-z]*lauf(?:e|s)?(?=-|$)"
)

SPORT_NOT = (
    r"(?:^|-)(?:ab|ver|durch|ein|aus|zu|an|um|rund|spiel)lauf(?:e|s)?(?=-|$)|lesung|vortrag|"
    r"buchvorstellung|buchpremiere|ausstellung|vernissage"
)

SPECTATOR_SPORT = (
    r"fussball|handball|eishockey|basketball|volleyball|heimspiel|auswaertsspiel|punktspiel|testspiel|"
    r"spieltag|laenderspiel|(?:^|-)(?:\d-)?(?:bundes|kreis|landes|ober|nord|sued|regional|verbands|"
    r"bezirks|stadt|amateur|profi|damen|herren|jugend|champions|euro)?liga(?:-|$)|(?:^|-)pokal|(?:^|"
    r"-)derby|public-viewing|(?:^|-)(?:dynamo|dsc|monarchs|titans)(?:-|$)|(?:^|-)vs(?:-|$)"
)

FILM_VENUE = (
    r"filmnaechte|rundkino|kristallpalast|schauburg|programmkino|zentralkino|lichtspiel|cinemaxx|"
    r"thalia-kino|kino-im-kasten"
)

DEMO = (
    r"(?:^|-)(?:demo|demos|gegendemo|fahrraddemo|raddemo|demonstration|kundgebung|mahnwache|menschenkette|"
    r"critical-mass|csd|christopher-street-day)(?=-|$)"
)

DEMO_NOT = r"demonstration-(?:des|der|eines|einer|von|vom|am|zum|zur|mit|an)(?=-|$)|(?:^|-)demo-?chor"

GUIDED = (
    r"(?:^|-)([a-z]*fuehrung(?:en)?|[a-z]*rundgang|[a-z]*rundgaenge|gefuehrte?[nrs]?|"
    r"stadtrundfahrt(?:en)?|nachtwaechter[a-z]*)(?=-|$)"
)

GUIDED_NOT = (
    "vorfuehrung", "auffuehrung", "einfuehrung", "entfuehrung", "unterfuehrung", "ausfuehrung", "durchfuehrung",
    "verfuehrung", "ueberfuehrung", "zufuehrung", "fortfuehrung", "weiterfuehrung",
)

STOPWORDS = (
    "der", "die", "das", "und", "mit", "von", "im", "in", "am", "auf", "ein", "eine", "einer", "einen", "zum",
    "zur", "an", "bei", "fuer", "für", "des", "dem", "den", "vom", "als", "auch", "ist", "sind", "open", "air",
    "tour",
)

TAG_CHURCH = (
    "kirche", "dom", "kloster", "kathedrale", "kapelle", "kreuzkirche",
)

TAG_MUSEUM = (
    "museum", "sammlung", "ausstellungshaus", "gedenkstaette", "schloss",
)

TAG_MUSEUM_NOT = (
    "schlossplatz", "schlosserei",
)

TAG_CLASSICAL = (
    "klassik", "philharmon", "sinfoni", "orchester", "kammermusik", "orgel", "oper", "chor",
)

# Regions.
NEARBY_TOWNS = (
    "radebeul", "freital", "coswig", "heidenau", "moritzburg", "radeberg", "pirna", "radeburg", "weinboehla",
    "bannewitz", "kreischa", "wilsdruff", "arnsdorf", "dohna", "klipphausen", "tharandt", "possendorf", "graupa",
    "pesterwitz", "friedewald", "serkowitz", "zuschendorf", "grosssedlitz", "sonnenstein", "boxdorf", "reichenberg",
    "ottendorf-okrilla", "duerrroehrsdorf", "wachau", "seifersdorf", "mohorn", "unkersdorf", "constappel",
    "cossmannsdorf",
)

FAR_TOWNS = (
    "meissen", "kamenz", "pulsnitz", "bautzen", "goerlitz", "leipzig", "cottbus", "hoyerswerda", "zittau",
    "chemnitz", "weimar", "berlin", "riesa", "grossenhain", "zabeltitz", "nossen", "doebeln", "torgau", "freiberg",
    "rammenau", "grossroehrsdorf", "elstra", "ohorn", "burkau", "stolpen", "hohnstein", "sebnitz", "neukirch",
    "koenigstein", "rathen", "gohrisch", "struppen", "wehlen", "lohmen", "bad-schandau", "bad-gottleuba",
    "berggiesshuebel", "rosenthal-bielatal", "papstdorf", "reinhardtsdorf", "krippen", "porschdorf", "rauenstein",
    "dippoldiswalde", "altenberg", "lauenstein", "geising", "schmiedeberg", "glashuette", "weesenstein", "maxen",
    "liebstadt", "kipsdorf", "rabenau", "hermsdorf-erzgebirge", "seiffen", "olbernhau", "annaberg", "herrnhut",
    "weisswasser", "knappenrode", "finsterwalde", "cunewalde", "schirgiswalde", "marienberg", "mortka", "domsdorf",
    "hinterhermsdorf", "kleinhennersdorf", "niederau", "proschwitz", "jahnishausen", "altdoebern", "tiefenau",
    "gostewitz", "mahlitzsch", "goedelitz", "saechsische-schweiz", "neustadt-in-sachsen",
)

VENUE_REGIONS = (
    ("schloss-wackerbarth", "umland"),
    ("hofloessnitz", "umland"),
    ("landesbuehnen", "umland"),
    ("weingut-aust", "umland"),
    ("haus-steinbach", "umland"),
    ("tom-pauls", "umland"),
    ("schloss-batzdorf", "umland"),
    ("saxstall", "umland"),
    ("zentralgasthof", "umland"),
    ("hochstift", "weiter"),
    ("albrechtsburg", "weiter"),
    ("erlebniswelt-meissen", "weiter"),
    ("porzellan-manufaktur", "weiter"),
    ("kulturinsel", "weiter"),
    ("turisede", "weiter"),
    ("terra-mineralia", "weiter"),
    ("roedersaal", "weiter"),
    ("felsenbuehne", "weiter"),
    ("robert-sterl", "weiter"),
    ("osterzgebirgsmuseum", "weiter"),
    ("naturbuehne-maxen", "weiter"),
    ("kloster-altzella", "weiter"),
    ("barockschloss-rammenau", "weiter"),
    ("deutsch-sorbisches", "weiter"),
    ("alte-wasserkunst", "weiter"),
    ("stadthalle-krone", "weiter"),
    ("museum-der-westlausitz", "weiter"),
    ("kunsthalle-lausitz", "weiter"),
    ("gerhart-hauptmann-theater", "weiter"),
    ("martin-moller", "weiter"),
    ("gunzenhauser", "weiter"),
    ("schlossbergmuseum", "weiter"),
    ("grassi", "weiter"),
    ("gladhouse", "weiter"),
    ("weimarhalle", "weiter"),
    ("kirms-krackow", "weiter"),
    ("kulturweberei", "weiter"),
    ("danner-halle", "weiter"),
    ("energiefabrik", "weiter"),
    ("brikettfabrik-louise", "weiter"),
    ("naturerlebniszentrum-hebelei", "weiter"),
    ("heymannbaude", "weiter"),
    ("belantis", "weiter"),
    ("mittelsaechsisches-theater", "weiter"),
    ("sorbisches-national", "weiter"),
    ("nationalparkzentrum", "weiter"),
    ("schloss-bieberstein", "weiter"),
    ("kuckuckstein", "weiter"),
    ("toskana-therme", "weiter"),
    ("dreilaendereck", "weiter"),
    ("karrasburg", "umland"),
    ("adams-gasthof", "umland"),
)

CITY_VENUES = (
    "riesa-efau", "motorenhalle", "leipziger-bahnhof",
)

# Duplicate search.
GENERIC_VENUE_WORDS = (
    "club", "dresden", "e", "v", "ev", "der", "die", "das", "im", "in",
)

UNKNOWN_VENUES = (
    "tba", "tbc", "unknown", "unbekannt", "secret-location", "ort-folgt", "location-siehe-beschreibung",
    "siehe-beschreibung", "geheim", "secret", "location-tba", "wird-noch-bekannt-gegeben",
)

TITLE_STOPWORDS = (
    "the", "und", "and", "mit", "with", "feat", "featuring", "presents", "praesentiert", "pres", "der", "die",
    "das", "dresden", "party", "im", "in",
)

# Exclusion. HOTEL is read against the venue's slug, the others against the lower-case title.
HOTEL = r"hotel|gasthof"

SENIORS = r"senior|\b60 ?\+|\bü ?60\b|ältere[nr]? menschen|aeltere[nr]? menschen"

CANCELLED = r"abgesagt|fällt aus|faellt aus|entfällt|entfaellt|cancel+ed"

TOURISTS = (
    r"candlelight|babykonzert|stadtabenteuer|wein(?:bergs?)?wanderung|weinverkostung|weinprobe|"
    r"verkostung von \d+ .*weinen"
)

# Facets.
FACET_WORDS = {
    "club": (
        r"(?:^|-)(?:techno|[a-z]*house|rave|[a-z]*party|partys|dj|djs|djane|dj-?set|electro|elektro|"
        r"electronic|drum-(?:and|n)-bass|dnb|disco|hip-?hop|rap|dancehall|clubnacht|bass|trance|psytrance|goa|"
        r"afrobeats?|reggaeton|ebm|darkwave|minimal)(?=-|$)"
    ),
    "rock": (
        r"(?:^|-)(?:[a-z]*rock|[a-z]*metal|hardcore|grunge|ska|rockabilly|rock-n-roll|stoner|doom|thrash|emo|"
        r"garage)(?=-|$)"
    ),
    "indie": (
        r"(?:^|-)(?:[a-z]*punk|indie|indiepop|singer-songwriter|songwriter|folk|pop|acoustic|akustik|"
        r"unplugged|liedermacher|chanson)(?=-|$)"
    ),
    "jazz": (
        r"(?:^|-)(?:[a-z]*jazz|blues|swing|soul|funk|dixie|dixieland|bebop|bigband|big-band|jam-?session|"
        r"jamsession)(?=-|$)"
    ),
    "klassik": (
        r"klassik|orchester|sinfoni|symphon|philharmon|kammermusik|kantate|oratorium|liederabend|requiem|"
        r"motette|kirchenmusik|klavierabend|streichquartett|orgel|(?:^|-)(?:chor|choere|chorkonzert|quartett|"
        r"bach|mozart|beethoven|haendel)(?=-|$)"
    ),
    "buehne": (
        r"theater|kabarett|comedy|comedian|operette|ballett|musical|schauspiel|revue|poetry|slam|zirkus|"
        r"variete|kleinkunst|improtheater|lesebuehne|stand-?up|(?:^|-)(?:oper|impro|show|musical)(?=-|$)"
    ),
    "film": (
        r"(?:^|-)(?:film|filme|kino|doku|dokumentarfilm|kurzfilm|kurzfilme|filmnacht|filmabend|kinoabend|"
        r"filmreihe|filmvorfuehrung|sneak)(?=-|$)"
    ),
    "wort": (
        r"lesung|vortrag|vortraege|gespraech|diskussion|podium|literatur|buchpremiere|buchvorstellung|"
        r"erzaehlcafe"
    ),
    "kunst": r"ausstellung|vernissage|finissage|museum|galerie|atelier|(?:^|-)kunst(?=-|$)",
}

FACET_NOT = {
    "rock": r"barock|rocky|minirock",
    "club": r"kinderparty|kinder-party|(?:^|-)house-of(?=-|$)",
    "indie": r"popcorn|pop-up|popup|(?:^|-)[a-z]*punkt(?=-|$)",
}

SPORT_MORE = (
    r"team-?challenge|firmenlauf|spendenlauf|stadtlauf|volkslauf|fun-?run|(?:^|-)run(?=-|$)|(?:^|"
    r"-)(?:yoga|lauf|laufen|eislaufen|schlittschuh|schlittschuhlaufen)(?=-|$)"
)

SPORT_EXCLUDED = (
    r"senior|(?:^|-)ue-?(?:50|55|60|65|70)(?=-|$)|(?:^|-)(?:50|60|65)-?plus(?=-|$)|kinder|kids|familie|"
    r"eltern|baby|babys|kleinkind|mutter-kind|vater-kind|kita|seniorenheim|schueler|(?:^|-)jugend"
)

# Parts of the slugs of large houses, whose programmes come whole from elsewhere.
LARGE_HOUSES = (
    "semperoper", "staatsoperette", "staatsschauspiel", "kleines-haus", "schauspielhaus", "landesbuehnen",
    "deutsches-nationaltheater", "philharmonie", "kulturpalast", "tjg", "theater-junge-generation",
    "boulevardtheater", "theaterkahn", "societaetstheater", "carte-blanche", "comoedie", "herkuleskeule",
    "residenzschloss", "residenzschloss-dresden", "gruenes-gewoelbe", "kupferstich-kabinett", "gemaeldegalerie",
    "albertinum", "zwinger", "japanisches-palais", "deutsches-hygiene-museum", "hygiene-museum", "verkehrsmuseum",
    "karl-may-museum", "stadtmuseum", "militaerhistorisches", "slub", "landesbibliothek", "technische-sammlungen",
    "kunstsammlungen", "anna-amalia",
    "frauenkirche", "kreuzkirche", "hofkirche", "kathedrale", "dom", "annenkirche", "martin-luther-kirche",
    "albrechtsburg", "festung", "schloss-pillnitz", "schloss-uebigau", "schloss-klippenstein", "schloss-moritzburg",
    "schloss-wackerbarth", "barockschloss", "burg-stolpen", "grosssedlitz", "schloss-weesenstein",
    "schloss-schoenfeld", "kloster-altzella",
    "filmnaechte", "freilichtbuehne-junge-garde", "junge-garde", "felsenbuehne", "seebuehne", "amphitheater",
    "konzertplatz-weisser-hirsch", "hellerau", "messe-dresden", "rudolf-harbig-stadion",
    "touristservice", "glaeserne-manufaktur", "erlebniswelt", "yenidze",
)

# Words in a feed's categories that let an entry in, and the raw category they stand for.
FEED_CATEGORIES = (
    ("demo", "kundgebung"), ("kundgebung", "kundgebung"), ("konzert", "konzert"), ("film", "film"), ("theater", "theater"),
    ("küfa", ""), ("kneipe", ""),
)

# An assembly with one of these in its status does not take place.
ASSEMBLY_OFF = ("abgemeldet", "verboten")
