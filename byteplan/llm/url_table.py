"""A small labelled table of URLs, hosts invented, in the shape of what crawls bring.

Words that mark unwanted sites also stand in harmless URLs (reports, histories, help pages) and the other way
round, so a URL's words decide together.
"""

BLOCK = """
www.royal-casino-bonus.example.com/free-spins/signup
play.casino-vegas24.example.net/slots?aff=118
best-betting-odds.example.com/casino/live-tables
m.online-casino-list.example.org/top10/no-deposit
www.luckyseven.example.com/casino/roulette
poker-room.example.net/download/client.exe
www.pokerstars-clone.example.org/poker/freeroll
tables.holdem-money.example.com/poker/12.html
betting-tips-today.example.com/sure-win/football
www.sportbet.example.net/betting/live/odds
m.betting365.example.org/register?promo=100
mega-jackpot.example.com/claim/now
www.winbig.example.net/jackpot/tickets
jackpot-lottery-winner.example.org/prize/form
free-porn-tube.example.com/videos/hd
www.porn-cams.example.net/live/room/7
hot.tubesite.example.org/porn/amateur
xxx-movies.example.net/stream/18
www.best-xxx.example.com/gallery/23
cam.nightclub.example.com/xxx/private
city-escort-girls.example.com/berlin
www.vip-escort.example.net/booking
ladies.example.org/escort/rates
buy-viagra-online.example.com/no-prescription
www.viagra-express.example.net/order/100mg
pharma24.example.org/viagra/discount
diet-pills-fast.example.com/slim/order
www.cheap-pills.example.net/cart?item=cialis
meds.example.org/pills/without-recipe
spam-mailer.example.com/bulk/send
www.bulk-spam-lists.example.net/buy/emails
mailblast.example.org/spam/million-addresses
malware-drop.example.com/payload/update.exe
www.flashupdate.example.net/malware/install
cdn.badhost.example.org/malware/dropper.js
secure-login-phishing.example.com/bank/verify
www.account-check.example.net/phishing/signin
paypa1.example.org/phishing/confirm-password
warez-planet.example.com/full/isos
www.warez-forum.example.net/releases
warez.keygens.example.org/full/keygen
casino.example.org/bonus/12
porn.example.org/free/7
crack-serials.example.com/windows/activate
www.game-crack.example.net/nocd
soft.example.org/crack/patch.zip
torrent-bay.example.com/top/movies
www.fast-torrent.example.net/magnet/2231
media.sharez.example.org/torrent/series/s01
crypto-scam-double.example.com/send-btc
www.prize-scam.example.net/you-won
invest.example.org/scam/guaranteed-returns
clickbait-daily.example.com/you-wont-believe
www.viral-clickbait.example.net/shocking/12
buzz.example.org/clickbait/one-weird-trick
linkfarm-network.example.com/links/page/88
www.seo-linkfarm.example.net/directory/9911
spam.bulkmail.example.org/lists/backlinks
spam-hosting.example.org/offshore/servers
www.spam.example.net/en/lists
cheap-watches-outlet.example.com/sale
www.cheap-handbags.example.net/outlet/70-off
store.example.org/cheap/sneakers-wholesale
replica-rolex.example.com/catalog
www.replica-bags.example.net/luxury/copy
shop.luxuryco.example.org/replica/watches
adserver.mediabuy.example.com/banner?id=9
www.adserver-cdn.example.net/popunder.js
serve.example.org/adserver/imp/3311
tracker.pixelhub.example.com/p.gif?u=71
www.tracker-stats.example.net/collect
log.example.org/tracker/beacon/1x1
www.ardin.example.com/casino/4431.html
m.belmor.example.net/poker/17
www.cordal.example.org/betting/2290.html
blog.dunvar.example.com/jackpot/8
www.eldrin.example.net/porn/663.html
m.fosgar.example.org/xxx/12.html
www.galden.example.com/escort/905
shop.hamrel.example.net/viagra/31.html
www.ilvent.example.org/pills/7745
m.jorsal.example.com/spam/20.html
www.kulmer.example.net/malware/118
files.lomdar.example.org/phishing/4.html
www.mardol.example.com/warez/5060.html
m.nirven.example.net/crack/77
www.oldfer.example.org/torrent/936.html
blog.pasgol.example.com/scam/15
www.quendar.example.net/clickbait/2.html
m.rustel.example.org/linkfarm/341
shop.sandor.example.com/cheap/88.html
www.tulmas.example.net/replica/1204
m.ulvren.example.org/adserver/60.html
www.vindal.example.com/tracker/7.html
library-of-poker-jackpot.example.com/museum/bonus
news-betting-casino.example.net/health/odds
recipes-for-viagra-pills.example.org/school/order
free-music-torrent-crack.example.com/docs/full
travel-escort-xxx.example.net/calendar/girls
breaking-news-scam.example.org/you-won/claim-prize
weather-toolbar-malware.example.com/install/setup.exe
games-warez-crack.example.net/sports/download
forum-spam-linkfarm.example.org/links/buy
""".split()

ALLOW = """
www.dailynews.example.com/politics/election-results
news.rivertown.example.org/local/2023/04/bridge-opens
m.example.net/news/world/12.html
blog.annika.example.com/2021/bread-baking
www.dev-blog.example.net/posts/faster-queries
writers.example.org/blog/notes
en.openwiki.example.org/wiki/Photosynthesis
wiki.linuxhelp.example.net/install/network
kb.example.com/wiki/printers
www.city-museum.example.org/exhibitions/bronze-age
museum-of-glass.example.com/visit/tickets
arts.example.net/museum/opening-hours
www.public-library.example.com/catalogue/search?q=maps
library.university.example.net/journals/biology
town.example.org/library/reading-room
weather.example.com/forecast/oslo
www.stormwatch.example.net/weather/radar
m.sky.example.org/weather/weekend
www.home-recipes.example.com/soup/lentil
recipes.grandma.example.net/apple-cake
kitchen.example.org/recipes/bread
www.rose-garden.example.com/pruning/spring
garden-plans.example.net/vegetables/beans
home.example.org/garden/tools
www.hillside-school.example.org/parents/timetable
school.district.example.com/enrolment/forms
kids.example.net/school/lunch-menu
www.worldhistory.example.com/rome/republic
history-atlas.example.net/maps/1848
past.example.org/history/railways
www.popular-science.example.com/physics/light
science-journal.example.net/articles/883
lab.example.org/science/experiments
travel-notes.example.com/lisbon/trams
www.slow-travel.example.net/by-train/alps
trips.example.org/travel/packing-list
music-lessons.example.com/piano/scales
www.choir-music.example.net/concerts
radio.example.org/music/jazz
sports-club.example.com/fixtures/u12
www.local-sports.example.net/results/rowing
team.example.org/sports/training
docs.buildtool.example.com/guide/install
www.api-docs.example.net/v2/reference
sdk.example.org/docs/changelog
forum.gardeners.example.com/thread/771
www.bike-forum.example.net/topic/brakes
talk.example.org/forum/rules
farmers-market.example.com/stalls/honey
www.flea-market.example.net/sunday
goods.example.org/market/prices
www.cityhall.example.com/permits/parking
city-guide.example.net/walks/old-town
plan.example.org/city/transport
health-service.example.com/vaccines/schedule
www.public-health.example.net/clinics
care.example.org/health/first-aid
film-festival.example.com/programme
www.short-film.example.net/awards/2019
cinema.example.org/film/reviews
calendar.parish.example.com/june
www.events-calendar.example.net/week/23
dates.example.org/calendar/holidays
gallery.watercolours.example.com/landscapes
www.photo-gallery.example.net/birds
prints.example.org/gallery/etchings
www.kelvar.example.com/en/4512.html
m.rosmal.example.net/fr/881/
blog.fender.example.org/de/19?page=2
shop.bilsam.example.com/es/77#top
www.gartol.example.net/en/12.html
m.delnis.example.org/fr/5/
blog.satrem.example.com/de/408
shop.mondil.example.net/es/2200
www.pernol.example.org/en/1.html
m.hastid.example.com/fr/93/
www.ledmar.example.net/about/contact
m.fintor.example.org/team/imprint
blog.bosnet.example.com/archive/2020/05
shop.rimdal.example.net/shipping/returns
www.nolset.example.org/faq
www.sotmir.example.com/12.html
help.printerco.example.com/install/drivers
www.nethelp.example.org/install/router
www.elections.example.com/results/turnout
m.tildan.example.net/en/9000.html
www.warsol.example.com/story/3310.html
m.yarnel.example.net/story/12
www.zendar.example.org/page/801.html
blog.brasken.example.com/notes/5.html
museum.example.com/history/of-poker-and-card-games
health.example.net/science/why-some-pills-dissolve
docs.example.org/wiki/phishing-and-how-to-report-it
history-blog.example.com/city/casino-architecture
""".split()


def labelled_urls() -> list[tuple[str, bool]]:
    """(url, is to be blocked), the two kinds by turns."""
    rows, most = [], max(len(BLOCK), len(ALLOW))
    for i in range(most):
        rows += [(f"https://{kind[i]}", kind is BLOCK) for kind in (BLOCK, ALLOW) if i < len(kind)]
    return rows
