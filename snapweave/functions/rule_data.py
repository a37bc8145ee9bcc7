"""The default exclusion rules (pattern | reason), project markers and system locations, in matching order."""

JUNK = """
desktop.ini | Windows folder view settings
Thumbs.db | Windows thumbnail cache
ehthumbs.db | Windows thumbnail cache
.DS_Store | macOS folder view settings
._* | macOS resource fork sidecar
.Spotlight-V100/ | Spotlight index
.fseventsd/ | filesystem event log
.Trash/ | trash
.Trash-*/ | trash
$RECYCLE.BIN/ | recycle bin
*.lnk | Windows shortcut, target is backed up instead
*.tmp | temporary file
*.temp | temporary file
~$* | Office lock file
.~lock.*# | LibreOffice lock file
*.crdownload | incomplete browser download
*.part | incomplete download
*.partial | incomplete download
*.swp | editor swap file
*.swo | editor swap file
*~ | editor backup file
nohup.out | stray process output
"""

CACHE = """
**/Cache/ | regenerable cache
**/Cache_Data/ | regenerable cache
**/CacheStorage/ | regenerable cache
**/Code Cache/ | browser code cache
**/GPUCache/ | GPU shader cache
**/ShaderCache/ | GPU shader cache
**/GrShaderCache/ | GPU shader cache
**/Service Worker/CacheStorage/ | service worker cache
**/Crashpad/ | crash reporter state
**/CrashReports/ | crash reports
**/component_crx_cache/ | browser component cache
.cache/ | generic cache directory
.npm/_cacache/ | npm package cache
.yarn/cache/ | Yarn package cache
.pnpm-store/ | pnpm content store
.bun/install/cache/ | Bun package cache
.gradle/caches/ | Gradle cache
.m2/repository/ | Maven repository cache
.ivy2/cache/ | Ivy cache
.sbt/boot/ | sbt boot cache
.cargo/registry/ | Cargo registry cache
.cargo/git/ | Cargo git checkout cache
.rustup/toolchains/ | Rust toolchains, reinstallable
.go/pkg/mod/ | Go module cache
go/pkg/mod/ | Go module cache
go/pkg/sumdb/ | Go checksum database cache
.nuget/packages/ | NuGet package cache
.composer/cache/ | Composer cache
.gem/ | RubyGems cache
.pub-cache/ | Dart/Flutter package cache
.cocoapods/ | CocoaPods cache
.conda/pkgs/ | Conda package cache
.docker/ | Docker client state and caches
.vscode/extensions/ | editor extensions, reinstallable
.android/avd/ | Android emulator images, rebuildable
Library/Caches/ | macOS user caches
AppData/Local/Temp/ | Windows user temp
AppData/Local/Microsoft/Windows/INetCache/ | Internet Explorer cache
AppData/Local/Microsoft/Windows/Explorer/ | Explorer thumbnail cache
AppData/Local/Packages/ | Windows Store app state
AppData/Local/CrashDumps/ | crash dumps
AppData/LocalLow/ | low-integrity app scratch data
OneDriveTemp/ | OneDrive scratch directory
"""

VIRTUALISATION = """
*.vdi | VirtualBox disk image
*.vmdk | VMware disk image
*.vhd | Hyper-V disk image
*.vhdx | Hyper-V disk image
*.qcow2 | QEMU disk image
*.img | raw disk image
*.iso | optical disc image, usually re-downloadable
*.dmg | macOS disk image, usually re-downloadable
*.hds | Parallels disk image
*.pvm/ | Parallels virtual machine bundle
*.vmwarevm/ | VMware virtual machine bundle
VirtualBox VMs/ | VirtualBox machine directory
wsl/ | WSL distribution images
docker-desktop-data/ | Docker Desktop virtual disk
*.vswap | virtual machine swap
*.avhdx | Hyper-V differencing disk
"""

EPHEMERAL = """
*.sock | unix socket
*.pid | process id file
*.lock | lock file
.sync/ | sync client scratch data
.dropbox.cache/ | Dropbox cache
.dropbox/ | Dropbox client state
*.icloud | iCloud placeholder for an evicted file
AppData/Roaming/Microsoft/Windows/Recent/ | recent items list
AppData/Local/D3DSCache/ | DirectX shader cache
Steam/steamapps/ | game installs, redownloadable from Steam
steamapps/ | game installs, redownloadable from Steam
Epic Games/ | game installs, redownloadable
Battle.net/ | game installs, redownloadable
Riot Games/ | game installs, redownloadable
"""

DEVELOPER = """
.git/ | Git object store; source files are backed up, history lives on the remote
.svn/ | Subversion metadata; working copy files are backed up
.hg/ | Mercurial metadata; working copy files are backed up
node_modules/ | reinstallable with npm install
bower_components/ | reinstallable dependency directory
jspm_packages/ | reinstallable dependency directory
.next/ | Next.js build cache
.nuxt/ | Nuxt build cache
.svelte-kit/ | SvelteKit build cache
.astro/ | Astro build cache
.angular/ | Angular build cache
.parcel-cache/ | Parcel cache
.turbo/ | Turborepo cache
.nx/cache/ | Nx cache
.vite/ | Vite cache
.webpack/ | webpack cache
.nyc_output/ | coverage scratch data
.pytest_cache/ | pytest cache
.mypy_cache/ | mypy cache
.ruff_cache/ | ruff cache
.tox/ | tox environments
__pycache__/ | Python bytecode cache
*.pyc | Python bytecode
*.pyo | Python bytecode
.venv/ | Python virtual environment, recreatable
.terraform/ | Terraform provider plugins
.serverless/ | Serverless framework build output
.dart_tool/ | Dart build state
.gradle/ | Gradle project state
.idea/ | IDE local workspace state
.vs/ | Visual Studio local state
CMakeFiles/ | CMake scratch directory
cmake-build-*/ | CMake build directory
DerivedData/ | Xcode build output
*.xcworkspace/xcuserdata/ | Xcode per-user state
*.class | compiled Java class
*.egg-info/ | Python package metadata, regenerated on build
"""

#: Inside any detected project only.
DEVELOPER_SCOPED = """
vendor/ | vendored dependencies, reinstallable
target/ | build output
build/ | build output
dist/ | build output
out/ | build output
bin/ | build output
obj/ | build output
.build/ | build output
coverage/ | test coverage report
venv/ | Python virtual environment, recreatable
env/ | Python virtual environment, recreatable
Pods/ | CocoaPods checkout, reinstallable
logs/ | project log directory
*.log | log file
tmp/ | project scratch directory
*.o | object file
*.a | static library build output
"""

#: Marker | kind | directories it excludes, relative to the project | reason. A marker with a leading `*` is a name's ending.
MARKERS = """
package.json | node | node_modules .next .nuxt .svelte-kit .astro .angular .parcel-cache .turbo .vite dist build out coverage .nyc_output | Node.js project: dependencies and build output are reproducible with a package install
pnpm-lock.yaml | node | node_modules .pnpm-store | pnpm project: dependencies are reproducible from the lockfile
yarn.lock | node | node_modules .yarn/cache .yarn/unplugged | Yarn project: dependencies are reproducible from the lockfile
bun.lockb | node | node_modules | Bun project: dependencies are reproducible from the lockfile
deno.json | node | node_modules | Deno project: dependencies are cached, not source
go.mod | go | vendor bin dist | Go module: vendored dependencies and binaries are reproducible with go build
Cargo.toml | rust | target | Cargo project: target/ is build output
pyproject.toml | python | .venv venv dist build __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox *.egg-info | Python project: virtual environments and caches are recreatable
requirements.txt | python | .venv venv __pycache__ .pytest_cache | Python project: virtual environments are recreatable with pip install
Pipfile | python | .venv __pycache__ | Pipenv project: the virtual environment is recreatable
setup.py | python | .venv venv build dist __pycache__ *.egg-info | Python project: build artefacts are recreatable
pom.xml | java | target | Maven project: target/ is build output
build.gradle | gradle | build .gradle app/build | Gradle project: build/ and .gradle/ are build state
build.gradle.kts | gradle | build .gradle app/build | Gradle project: build/ and .gradle/ are build state
composer.json | php | vendor | Composer project: vendor/ is reproducible with composer install
Gemfile | ruby | vendor/bundle .bundle tmp log | Bundler project: gems are reproducible with bundle install
pubspec.yaml | dart | .dart_tool build .flutter-plugins | Dart/Flutter project: build state is recreatable
mix.exs | elixir | _build deps | Elixir project: deps and _build are reproducible with mix deps.get
Package.swift | swift | .build Packages | Swift package: .build is build output
CMakeLists.txt | cmake | build cmake-build-debug cmake-build-release CMakeFiles out | CMake project: build directories are regenerable
Makefile | cmake | | Make project
main.tf | terraform | .terraform | Terraform project: provider plugins are re-downloadable
Gopkg.toml | go | vendor | Go dep project: vendor/ is reproducible
ProjectSettings | unity | Library Temp Obj Build Builds Logs | Unity project: Library/ and build folders are regenerated from Assets
gradle.properties | gradle | build .gradle | Gradle project: build state is regenerable
Directory.Build.props | dotnet | bin obj packages | .NET project: bin/ and obj/ are build output
*.csproj | dotnet | bin obj packages | .NET project: bin/ and obj/ are build output
*.fsproj | dotnet | bin obj | .NET project: bin/ and obj/ are build output
*.vbproj | dotnet | bin obj | .NET project: bin/ and obj/ are build output
*.sln | dotnet | bin obj .vs packages | .NET solution: build output and IDE state
*.xcodeproj | swift | build DerivedData Pods | Xcode project: build output and CocoaPods checkout
*.uproject | unreal | Binaries Build DerivedDataCache Intermediate Saved | Unreal project: intermediate and derived data are regenerable
"""

SYSTEM_LINUX = """
/proc | kernel process interface
/sys | kernel object interface
/dev | device nodes
/run | runtime state
/tmp | temporary files
/var/tmp | temporary files
/var/run | runtime state
/var/cache | package and application caches
/var/lib/docker | container layers, rebuildable
/var/lib/containers | container layers, rebuildable
/usr | operating system files
/bin | operating system binaries
/sbin | operating system binaries
/lib | operating system libraries
/lib64 | operating system libraries
/boot | bootloader and kernel images
/etc | system configuration
/opt | installed software
/srv | service data; add explicitly if wanted
/snap | snap package mounts
/lost+found | filesystem recovery area
/swapfile | virtual memory swap file
/swap.img | virtual memory swap file
/mnt | mount points; add specific drives explicitly
/media | removable media; add specific drives explicitly
"""

SYSTEM_MACOS = """
/System | macOS system volume
/Library | machine-wide application support
/Applications | installed applications
/usr | operating system binaries and libraries
/bin | operating system binaries
/sbin | operating system binaries
/etc | system configuration
/var/db | system database
/var/root | root home directory
/var/log | system logs
/var/vm | virtual memory files
/var/tmp | temporary files
/var/folders | per-user temporary files
/private/etc | system configuration
/private/var/db | system database
/private/var/root | root home directory
/private/var/log | system logs
/private/var/vm | virtual memory files
/private/var/folders | per-user temporary files
/tmp | temporary files
/private/tmp | temporary files
/cores | kernel core dumps
/dev | device nodes
/Volumes | mounted volumes; add specific drives explicitly
/.Spotlight-V100 | Spotlight index
/.fseventsd | filesystem event log
/.DocumentRevisions-V100 | macOS document revisions store
/.Trashes | trash
/.vol | volume metadata
"""

SYSTEM_WINDOWS = """
C:/Windows | Windows operating system files
C:/Program Files | installed software, not user data
C:/Program Files (x86) | installed software, not user data
C:/ProgramData | machine-wide application state
C:/Recovery | Windows recovery partition data
C:/$Recycle.Bin | recycle bin
C:/System Volume Information | Windows restore points and indexes
C:/PerfLogs | performance logs
C:/hiberfil.sys | hibernation image
C:/pagefile.sys | virtual memory page file
C:/swapfile.sys | virtual memory swap file
C:/DumpStack.log.tmp | crash dump scratch file
C:/Config.Msi | installer scratch directory
"""

#: System locations refused as a whole but not below: someone may back up a mounted drive.
SOFT = {"linux": "/tmp /var/tmp /run /mnt /media", "macos": "/tmp /private/tmp /var/folders /private/var/folders /cores /Volumes", "windows": ""}
