"""Labelled example sentences for the content classifier.

They give the model its categories, which reviewers' marks do not name.  They are written for this purpose: none
of up to five words, and no five consecutive words of a longer one, stand in the documents of the test tables.
"""

#: Categories in the order of the chain; the last is the verdict on the sentence.
CATEGORIES = ("sexual", "threat", "group", "insult", "offensive")

# fixed values: examples by category; '' holds sentences without offence
EXAMPLES = {
    "insult": """You are an idiot and nobody can stand you. | What a moron you are. | The author of this is a brainless fool. | You people are all retarded clowns. | Shut up, you worthless bastard. | Whoever wrote this is a complete asshole.
        That bitch from accounting is too stupid to read. | Go to hell, you miserable scumbag. | You are a waste of oxygen. | Our lead is human garbage, ask anybody. | Screw you and your whole family.
        Are you an imbecile or do you only act like one? | Nobody likes you, you pathetic loser. | Your mother should have thrown you away. | He is a lazy prick who smells like a pig. | Only a dumbass like you would write that.
        Did you lose your brain at birth? | You disgust me, you make me want to puke. | Crawl back under your rock, halfwit. | She is a stupid whore. | The guy who wrote that has shit for brains.
        The lazy author of that stinks like a sewer. | That worm from the other team kisses up to the boss. | Kiss my ass, you useless dickhead. | You suck up to the boss, you spineless worm. | Every one of you is one too many.
        Your parents must regret you. | you should be ashamed to exist | Du bist ein Idiot. | Halt die Klappe, du Trottel. | Was bist du nur für ein Vollidiot. | Du dumme Schlampe. | Wer das geschrieben hat, ist ein Schwachkopf.
        Verpiss dich, du Wichser. | Verpiss dich mit deinem Code. | Cállate, idiota. | Hijo de puta, no vales nada. | Qué estúpido eres. | Eres un inútil y lo sabe todo el mundo. | Tu es un imbécil. | Celui qui a fait ça est un abruti.
        Espèce de débile. | Dégage, sale con. | Va te faire voir, pauvre type. |
        Sei un idiota e non capisci niente. | Chiudi la bocca, stronzo. | Vaffanculo. | Você é um idiota completo. | Cala a boca, seu imbecil. | Je bent een idioot. | Hou je bek, klootzak. | Jesteś idiotą. | Zamknij się, kretynie. | Ты идиот. | Заткнись, урод.""",
    "threat": """I will kill you. | I am going to beat you up after work. | I hope you die on the way home. | Somebody should hang him. | We will find you and burn your house down. | I hope a truck hits you.
        Watch your back, next time it will be a bullet. | That colleague will find his tires slashed. | The maintainer deserves a beating, plain and simple. | They ought to be pulled through the street by the hair.
        I will make you suffer until you cannot walk. | Ich bringe dich um. | Pass auf, sonst steche ich dich ab. | Dich sollte man verprügeln. | Te voy a matar. | Ten cuidado o te reviento. | Ojalá te mueras. | Je vais te tuer.
        Fais attention à toi, on va te retrouver. | J'espère que tu vas crever. |
        Ti ammazzo. | So dove abiti, stai attento. | Eu vou te matar. | Sei onde você mora, cuidado. | Ik maak je dood. | Ik weet waar je woont. | Zabiję cię. | Я тебя убью. | Я знаю, где ты живёшь.""",
    "group": """Immigrants are vermin and should be thrown out. | Foreigners are all thieves. | Muslims are a disease. | Jews control everything and ruin it. | Gay people should be locked up. | The world would be better without disabled people.
        Old people should be got rid of. | People of that faith are animals and must be banned. | No foreigners on this team, they are filthy liars. | You can tell a woman wrote this, they have no brains.
        Those people should be grateful that we let them in at all. | God made them to serve us. | Their kind ruins everything. | Such people belong in the gutter, not here. | immigrants only spread filth, keep them out
        Ausländer sind Abschaum. | Frauen gehören an den Herd. | Flüchtlinge sind Ungeziefer, raus mit ihnen. | Diese Leute sind Ratten. | Frauen können das nicht, die sollen in der Küche bleiben.
        Ausländer raus, das sind doch alles Diebe. | Las mujeres a la cocina, no sirven para esto. | Hay que echar a todos los extranjeros. | Los gitanos son ladrones. | Les femmes à la cuisine.
        Les immigrés dehors, ce sont des parasites. | Les musulmans sont une maladie. | Les femmes ne savent pas faire ça, qu'elles restent à la cuisine. |
        Gli immigrati sono parassiti. | Le donne tornino in cucina. | Os imigrantes são uma praga. | Buitenlanders zijn tuig. | Uchodźcy to robactwo. | Женщины ни на что не годятся. | Мигранты это паразиты.""",
    "sexual": """Show me your naked body. | Her tits made me hard. | Suck my cock. | He slid his dick into her and she moaned. | Take off your clothes, I want to lick every inch of you. | I jerk off to your picture. | Bend over, baby.
        She was so wet when he fingered her. | I dream of your ass and your pussy. | He came all over her breasts. | I masturbate thinking about you. | spread your legs for me | Send me naked photos and I will sign it off.
        Your tits in that shirt got me hard in the meeting. | I will take you from behind on the table. | Ich will dich ficken. | Dein Arsch macht mich geil. | Zieh dich aus, dann gebe ich es frei. | Enséñame las tetas.
        Me pones cachondo. | Quítate la ropa para mí. | Mándame una foto desnuda. | Je veux te baiser. | Suce ma bite. | Déshabille-toi pour moi. |
        Voglio scoparti. | Fammi vedere le tette. | Quero te foder. | Mostra os peitos. | Ik wil je neuken. | Laat je tieten zien. | Chcę cię przelecieć. | Хочу тебя трахнуть. | Покажи сиськи.""",
    "": """The child process was killed after ten seconds. | Kill it with a signal and start again. | The master node is dead. | This parser is stupid, it drops empty lines. | What a dumb mistake of mine. | I was an idiot to merge that.
        This damn test fails again. | The crappy old code finally goes. | The filter flagged five abusive messages. | A column named sex holds one letter. | Refugees get a temporary number. | The breast cancer screening code is wrong.
        The penetration test found nothing. | A naked pointer is passed down. | It exposes the bare minimum. | We need a fool-proof setup. | Shut down the worker before the limit. | Fingering the wrong commit in blame is easy.
        The reviewer asked whoever wrote it to add a test. | Your branch is behind, please rebase it. | The slave follows the master. | Abort the job and strip the labels. | The dummy record is only for tests.
        Did you check the second case? | Someone reported a threat against a reviewer, see the ticket. | A user was called an idiot in the thread and reported it. | The query for breast milk returns nothing.
        The old people counter was renamed. | The group of immigrants in the sample is small. | Orphaned children are reaped at night. | The garbage collector runs twice. | Users can die of boredom while this loads.
        Fuck, I broke the build again. | Shit, wrong branch, my fault. | Well, that was a silly bug of ours. | Verdammt, der Test ist rot. | Der Filter meldet drei beleidigende Texte. | Bitte nicht zweimal schreiben.
        Frauen und Männer werden getrennt gezählt. | Hast du die Grenze geprüft? | El filtro marcó dos mensajes ofensivos. | Gracias, se ve bien. | Las mujeres y los hombres se cuentan aparte. | Ten en cuenta el límite del lote.
        And the same goes for the other one. | Stupid me, I forgot the entry. | fix(core): merge the entry | Zut, ce foutu test échoue. | Le filtre a signalé trois messages injurieux. | Les femmes et les hommes sont comptés séparément.
        Tu peux relire cette partie ? |
        Das Wetter bleibt bis Freitag schön. | Wir sehen uns am Montag in der Küche. | Der Zug hat zehn Minuten Verspätung. | Ich habe den Brief gestern gelesen. | Kannst du mir das Buch zeigen? | Die Kinder spielen im Garten. | Ist das dein Fahrrad? | Das ist für mich in Ordnung. | Das gefällt mir gut, vielen Dank.
        El tren llega con diez minutos de retraso. | Mañana te mando la carta. | ¿Me puedes enseñar el libro? | Los niños juegan en el jardín. | Esta noche cenamos todos juntos. | Creo que es una buena idea. | Se lo digo a mi hermana. | Está muy bien, de verdad.
        Le train a dix minutes de retard. | Je te montre la lettre demain. | Les enfants jouent dans le jardin. | Tu peux me prêter ton livre ? | On se retrouve ce soir à la maison. | C'est une bonne idée, je trouve. | Il fait beau depuis lundi. | C'est plus simple comme ça.
        The weather will stay fine until Friday. | She read the letter to her mother. | Can you show me the book? | The men and the women left on the same train. | He was hit by a wave of work. | Their family moved to another town. | I will see you on Monday. | People from many countries live here. | Everyone of us has to wait. | He passed her the salt.
        Il treno è in ritardo. | Grazie, va bene così. | Le donne e gli uomini aspettano fuori. | O trem está atrasado. | Obrigado, ficou muito bom. | De trein heeft vertraging. | Dank je, dat ziet er goed uit. | Pociąg jest opóźniony. | Dziękuję, wygląda dobrze. | Поезд опаздывает. | Спасибо, всё хорошо. | Женщины и мужчины стоят в очереди.""",
}


def examples() -> list[tuple[str, str]]:
    """(category, sentence); the category is '' for sentences that are not offensive."""
    return [(c, s.strip()) for c, block in EXAMPLES.items() for s in block.replace("\n", "|").split("|") if s.strip()]
