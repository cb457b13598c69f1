"""Fixed values for thread dumps: evidence words per block reason, confidence, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in the order they are tried.
EVIDENCE = {
    "io_on_main_thread": [
        "SQLiteDatabase", "SQLiteSession", "SharedPreferencesImpl", "FileInputStream", "FileOutputStream",
        "FileReader", "FileWriter", "RandomAccessFile", "ContentResolver.query", "ContentResolver.insert",
        "ContentResolver.update", "ContentResolver.delete", "AssetManager.open", "ZipFile.",
        "android.database.sqlite",
    ],
    "network_on_main_thread": [
        "HttpURLConnection", "OkHttp", "okhttp3.", "Socket.connect", "Socket.read", "SocketInputStream",
        "SocketOutputStream", "SSLSocket", "InetAddress", "NetworkDispatcher", "Volley", "retrofit2.",
        "java.net.URL.openConnection",
    ],
    "slow_binder_call": [
        "BinderProxy.transact", "BinderProxy.transactNative", "android.os.BinderProxy.transact",
        "IPCThreadState::transact", "IPCThreadState::waitForResponse", "android::IPCThreadState",
    ],
    "expensive_rendering": [
        "android.view.View.draw", "android.view.View.measure", "android.view.View.layout",
        "android.view.ViewGroup.dispatchDraw", "LayoutInflater.inflate", "RecyclerView.onLayout",
        "RecyclerView.onMeasure", "ThreadedRenderer", "ViewRootImpl.performTraversals",
    ],
    "content_provider_slow": [
        "ContentProvider$Transport.query", "ContentProvider$Transport.insert", "ContentProvider$Transport.update",
        "ContentProvider$Transport.delete", "ContentProvider$Transport.call",
    ],
    "broadcast_blocking": [
        "BroadcastReceiver.onReceive", "LoadedApk$ReceiverDispatcher", "ActivityThread.handleReceiver",
    ],
    "slow_app_startup": [
        "handleBindApplication", "Application.onCreate", "ContentProvider.onCreate",
        "ActivityThread.handleBindApplication",
    ],
}
IDLE_WORDS = ["nativePollOnce", "MessageQueue.next"]
PLATFORM_PREFIXES = ["android.", "com.android.", "java.", "javax.", "dalvik.", "libcore.", "sun."]
THREAD_STATES = ["Runnable", "Sleeping", "Waiting", "TimedWaiting", "Blocked", "Native", "Suspended"]
IN_BINDER_WORDS = [
    "IPCThreadState::transact", "IPCThreadState::talkWithDriver", "IPCThreadState::waitForResponse",
    "BinderProxy.transact",
]

# Names shown for the reasons.
LABELS = {
    "lock_contention": "Lock Contention",
    "deadlock": "Deadlock",
    "io_on_main_thread": "I/O on Main Thread",
    "network_on_main_thread": "Network on Main Thread",
    "slow_binder_call": "Slow Binder Call",
    "heavy_computation": "Heavy Computation on Main Thread",
    "expensive_rendering": "Expensive Rendering",
    "broadcast_blocking": "Broadcast Receiver Blocking",
    "slow_app_startup": "Slow App Startup",
    "idle_main_thread": "Idle Main Thread (Possible False ANR)",
    "no_stack_frames": "No Stack Frames Available",
    "system_overload_candidate": "System Overload (CPU Saturation)",
    "binder_pool_exhaustion": "Binder Thread Pool Exhaustion",
    "content_provider_slow": "Slow Content Provider",
    "unknown": "Unknown Cause",
}

# How sure a reason is by itself.
ALWAYS_HIGH = [
    "deadlock", "lock_contention", "network_on_main_thread", "io_on_main_thread", "slow_binder_call",
    "broadcast_blocking", "binder_pool_exhaustion", "content_provider_slow",
]
HIGH_WHEN_DEEP = ["heavy_computation", "expensive_rendering", "slow_app_startup"]
SCANS_OTHERS = ["idle_main_thread", "system_overload_candidate", "unknown"]


def block_reason(
    state: Column, waits: Column, in_cycle: Column, seen: dict[str, Column], idle: Column, app: Column,
    frames: Column, pool_exhausted: Column,
) -> Column:
    """``seen[reason]`` tells whether any frame shows the reason's evidence."""
    locked = (state == "Blocked") & waits
    chain = F.when(locked & in_cycle, "deadlock").when(locked, "lock_contention")
    for reason in EVIDENCE:
        chain = chain.when(seen[reason], reason)
    return (
        chain.when(pool_exhausted, "binder_pool_exhaustion")
        .when(idle, "idle_main_thread")
        .when((state == "Runnable") & app, "heavy_computation")
        .when(state == "Runnable", "system_overload_candidate")
        .when(frames == 0, "no_stack_frames")
        .otherwise("unknown")
    )


def confidence(reason: Column, frames: Column, has_suspects: Column) -> Column:
    return (
        F.when(has_suspects, "medium")
        .when(reason.isin(ALWAYS_HIGH), "high")
        .when(reason.isin(HIGH_WHEN_DEEP), F.when(frames > 3, "high").otherwise("medium"))
        .otherwise("low")
    )


def label(reason: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, reason), reason)


def trace_severity(reason: Column, sure: Column, has_suspects: Column) -> Column:
    return (
        F.when(reason == "idle_main_thread", F.when(has_suspects, "warning").otherwise("info"))
        .when(reason.isin("no_stack_frames", "unknown") | (sure == "low"), "warning")
        .otherwise("critical")
    )
