"""What words of English, Spanish, French and German say to a scorer of abusive, hateful and sexual language (problem 8).

Words stand for concepts; no word is a case by itself. `*` at the end of an entry stands for any ending. All entries are folded:
lower case, no accents. The lists are general vocabulary; what the labelled texts of a corpus add is learnt (see `content`).
"""

from __future__ import annotations

# Vocabulary by concept.
CONCEPTS = {
    "insult": """imbecile imbeciles parasite parasites idiot idiots cretin cretins bastard bastards scumbag halfwit idiot* moron* imbecil* cretin* halfwit* dumbass* jackass* bastard* scumbag* arsehole* asshole* twat* cunt* prick dickhead* bellend* shithead* motherfucker* numbskull* dimwit* wanker* tosser*
        bitch bitches whore whores slut sluts pig pigs swine scum retard retards retarded loser losers coward cowards liar liars fool fools clown clowns nitwit* dunce* douchebag* parasite parasites piece lowlife* creep creeps freak freaks
        idiota* cretino* desgraciad* inutil inutiles estupid* gilipollas cabron* pendej* puta putas puto putos hijueputa* cerdo cerdos maricon* zorra* payaso* tarado* subnormal* capullo* malnacid* escoria
        abruti* debile* connard* connasse* salope* salaud* enfoire* encule* batard* minable* ordure* pourriture* pute putes bouffon* crapule* raclure*
        arschloch* arschlocher vollidiot* schwachkopf* missgeburt* wichser* hurensohn* schlampe* depp deppen trottel drecksau* schwein schweine fotze* hure huren versager* dummkopf* penner dreckskerl* abschaum spast*""",
    "scorn": """brainless gutless spineless worthless lying rotten pathetic disgusting filthy stupid useless stinking miserable wretched vile dumb ugly lousy dirty bloody fucking damn goddamn
        asqueros* inutil estupid* patetic* repugnante* miserable maldit* jodid* sale stupide minable pathetique degueulasse pauvre dumm dumme* dreckig* wertlos* widerlich* erbarmlich* stinkend* verdammt* scheiss*""",
    "second": """you your yours yourself yourselves youre ur tu te ti tus tuyo eres contigo vosotros ustedes usted vete toi ton ta tes vous votre vos du dich dir dein deine deinen deinem deiner ihr euch euer""",
    "curse": """fuck fucks fucked fucker* fucking shit shits shitty piss crap screw arse joder jodete jodan mierda carajo chinga chingate follate merde putain foutre nique niquer gueule chier scheisse scheise scheiss scheis fick fickt verpiss fresse maul kacke""",
    "order": """shut crawl choke drown hang rot die drop stop callate callad largate muerete ahogate pudrete ferme degage creve noyer pendre verschwinde verreck* ertrink* stirb""",
    "harm": """kill kills killed killing stab stabs stabbed stabbing shoot shoots strangle* murder* beat beats behead* butcher* slit smash smashed choke knife knives bullet bullets rape raped knock break burn burns burned hang drown execute* slaughter* cripple torture* punch
        matar mato mata matare mataremos matarte maten matad apunal* acuchill* degoll* rompo romper romperte quemar quemare quemarte golpear cuchillo pegar pego tiro tuer tue tuez tuerai poignard* egorg* bruler brulerai brulons casser casse frapper etrangl* couteau buter crever
        toten tote totet umbringen umbringe erstech* erschlag* erschiess* verbrenn* abstech* schlage schlagen messer messern anzunden tot verprugel* aufschlitz*""",
    "will": """i we ill well will gonna going shall voy vamos te vas je vais on va nous allons viendra viendrons ich werde wir werden kommen komme hope wish ojala espero espere hoffe hoffentlich""",
    "deserve": """deserve deserves deserved should ought must needs need merece merecen hay debe deben merite meritent faut doit doivent verdient verdienen mussen muss gehort gehoren sollten sollte""",
    "near": """house home family mother children kids teeth neck legs face throat head car live casa familia madre cara cuello dientes vives maison famille mere dents visage gorge habites haus familie mutter gesicht hals zahne wohnst kopf""",
    "group": """immigrant* foreigner* refugee* migrant* muslim* jew jews jewish black blacks gay gays arab arabs gypsy gypsies christians hindus blacks lesbians trans asians whites
        inmigrante* extranjero* judio* musulman* moro moros negros gitano* refugiado* immigre* etranger* juif* musulmans arabe arabes noirs tsigane* refugies auslander* fluchtling* jude juden muslime* turken schwarze schwarzen zigeuner* migranten araber*""",
    "they": """they them their theirs ellos ellas ils leur leurs eux""",
    "slur": """nigger* nigga* faggot* fag fags kike* spic spics chink chinks tranny trannies wetback* paki pakis raghead* towelhead* gook gooks coon coons sudaca* negrata* bougnoul* youpin* bicot* negre negres neger kanake* kanaken schwuchtel* judensau*""",
    "dehuman": """vermin animal animals beast beasts rats rat parasites parasite filth filthy scum cockroach* disease plague subhuman* garbage trash savages pigs dogs apes monkeys thieves blood breed stink stinks dirty cancer swarm infest* multiply
        ratas animales basura escoria plaga cucarachas bestias perros ladrones sucia multiplican rats animaux vermine racaille ordures betes cafards voleurs salissent pourris multiplient ungeziefer ratten tiere abschaum dreck parasiten untermensch* diebe vermehren mull schmarotzer""",
    "remove": """exterminat* wiped gassed gas deport* expel* driven cleans* eradicat* removed eliminat* shot hanged burned burnt beaten cages cage ovens drown lynch* kill killed shoot out fence
        echar echarlos echarlas expulsar* exterminar* quemar quemarlos fuera eliminar jaulas deportar* dehors chasser exterminer expulser virer bruler raus verjagt vertrieb* vergas* ausrott* vernicht* abschieb* entfernt vertreiben kafig* hinaus""",
    "right": """human humans people person being count vote marry rent drink live rights breathe humano humana persona personas gente vivir humain humains personne personnes gens vivre mensch menschen person leben""",
    "negate": """not no never nobody none nothing arent isnt dont ningun ninguna nunca nadie ne pas jamais aucun aucune personne nicht kein keine keinen nie niemand""",
    "every": """all every last each any these those todos todas cada cualquier esos tous toutes chaque ces alle allen jeder jede jeden diese""",
    "explicit": """porn porno pornos pornograph* orgasm* masturbat* blowjob* handjob* cock cocks pussy pussies cum cumshot tits dildo* horny slutty hardcore anal milf milfs erection* cunnilingus fellatio ejaculat* clitoris penis vagina nipples xxx stripper* escorts threesome* bdsm
        follar follando follaron follada polla pollas tetas corrida cachond* mamada* baiser baise baisa bite chatte nichons salopes branler branle sucer pipe ejacul* ficken fickte gefickt geil geile geilen geiler titten schwanz muschi blasen wichsen wichst orgasmus orgasmo* orgasme*""",
    "sexual": """sex sexy naked nude nudes breasts breast thighs moan moaned moaning moans thrust thrusts lips bed webcam cam undress* kinky hot wet busty camera lust lusty tongue virgin bare housewives underwear panties bra lingerie kiss kissed caress* touch touching aroused
        sexo desnud* calientes caliente gemia gemido* muslos senos pechos cama excitad* sexe nue nues nus chaudes chaude gemissait cuisses seins lit excite* nackt nackte nackten stohnte schenkel bruste bett sex lust erregt""",
    "act": """fucked fucks fuck thrust thrusted rode mounted licked sucked penetrat* spread stripped tore ripped follo follaba penetro lamio baisait baisa penetra arracha lecha fickte ritt leckte riss stiess""",
    "person": """he she him her his hers herself himself woman women man men girl girls boy boys couple couples wife husband el ella lo la mujer mujeres hombre hombres chica chicas il elle lui femme femmes homme hommes fille filles couples er sie ihn ihm ihr frau frauen mann manner paare madchen""",
    "report": """word words term terms insult insults report reported reports diary slogan slogans condemned fined quoted quote letters letter court police editors editor article moderat* policy banned victim victims apologised apologized graffiti accused sentenced office complaint complaints called census clerks paper newspaper study education lecture
        palabra palabras insulto insultos condeno multa cartas juzgado policia articulo victimas periodico informe mot mots insulte insultes condamne amende lettres tribunal journal victimes rapport wort worte beleidigung* verurteil* gericht polizei zeitung bericht opfer brief briefe""",
    "thing": """file files format farm map maps survey code software version server driver legend border boundary tool script data dataset index query table mapa frontera carte fichier karte grenze datei""",
}
# Set phrases that are aimed at someone.
IDIOMS = [
    "shut up", "shut your", "piss off", "fuck off", "fuck you", "get lost", "go to hell", "drop dead", "piece of shit", "son of a bitch", "waste of space", "waste of skin", "kill yourself", "hang yourself", "where you live", "screw you", "eat shit", "full of shit", "burn in hell", "stop breathing",
    "hijo de puta", "hija de puta", "vete a la mierda", "que te jodan", "pedazo de", "donde vives", "te voy a", "la puta madre", "que te den",
    "ferme ta gueule", "ta gueule", "va te faire", "nique ta", "fils de pute", "ou tu habites", "espece de", "va te", "je vais te",
    "halt die fresse", "halt s maul", "halt dein maul", "verpiss dich", "fick dich", "leck mich", "du stuck", "wo du wohnst", "stuck scheisse", "ich werde dich", "fahr zur holle",
]
#: A people: a word with one of these endings, and no everyday word with them.
PEOPLE_ENDINGS = ("ian", "ians", "lander", "landers", "ese", "istani", "istanis")
NO_PEOPLE = frozenset("these those cheese geese lese diese obese islander islanders guardian guardians librarian meridian meridians median medians pedestrian pedestrians civilian civilians technician technicians".split())
#: Concepts whose words the decoder of disguises knows besides the corpus' words.
DISGUISED = ("insult", "scorn", "curse", "slur", "dehuman", "explicit", "sexual", "harm", "order", "remove", "act")
